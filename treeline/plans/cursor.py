"""Cursors: the sort values of a row, and what they are valid for, as one opaque string."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
from typing import Any

from treeline.errors import ValidationError
from treeline.plans.analyze import Node, scope

VERSION = 2


def _order(node: Node) -> list[dict]:
    return [{"field": s.field, "direction": "desc" if s.descending else "asc", "nulls": "first" if s.nulls_first else "last"} for s in node.order]


def _plain(value: Any) -> Any:
    """A value that JSON holds exactly; the column's type brings it back."""
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, "NaN")
    if isinstance(value, bytes | bytearray):
        raise ValidationError("binary columns cannot be paged by")
    return value


def encode(node: Node, values: list[Any]) -> str:
    told = {"v": VERSION, "entity": node.entity, "path": node.path, "order": _order(node), "values": [_plain(v) for v in values], "scope": scope(node)}
    return base64.urlsafe_b64encode(json.dumps(told, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(raw: str, node: Node) -> list[Any]:
    """The values of a cursor that was made for this very read."""
    try:
        told = json.loads(base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_", validate=True))
    except ValueError:
        raise ValidationError("the cursor cannot be read") from None
    if not isinstance(told, dict) or told.get("v") != VERSION or not isinstance(told.get("values"), list):
        raise ValidationError("the cursor cannot be read")
    for key, mine in (("entity", node.entity), ("path", node.path), ("order", _order(node)), ("scope", scope(node))):
        if told.get(key) != mine:
            raise ValidationError(f"the cursor belongs to another read (its {key} differs)")
    if len(told["values"]) != len(node.order) or any(isinstance(v, list | dict) for v in told["values"]):
        raise ValidationError("the cursor cannot be read")
    return told["values"]
