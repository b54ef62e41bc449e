"""Filters as Columns, and literals in the type of their column."""

from __future__ import annotations

import datetime
import decimal
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.errors import ValidationError
from treeline.plans.wire import Logic, Test

Typed = tuple[Column, T.DataType]


def literal(value: Any, kind: T.DataType) -> Column:
    """``value`` as a literal that compares with columns of ``kind`` without a cast of the column where possible."""
    if value is None:
        return F.lit(None).cast(kind)
    try:
        if isinstance(kind, T.StringType):
            return F.lit(str(value).lower() if isinstance(value, bool) else str(value))
        if isinstance(kind, T.BooleanType):
            if isinstance(value, str) and value.lower() not in ("true", "false"):
                raise ValueError(value)
            return F.lit(value.lower() == "true" if isinstance(value, str) else bool(value))
        if isinstance(kind, T.IntegralType):
            if isinstance(value, str):
                value = int(value)
            if isinstance(value, float) and value.is_integer():
                value = int(value)
            if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
                return F.lit(decimal.Decimal(value))
            return F.lit(value)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return F.lit(float(value)) if math.isfinite(float(value)) or not isinstance(value, int) else F.lit(decimal.Decimal(value))
        if isinstance(kind, T.DecimalType):
            return F.lit(decimal.Decimal(str(value)))
        if isinstance(kind, T.DateType):
            return F.lit(datetime.date.fromisoformat(str(value)[:10]))
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            datetime.datetime.fromisoformat(str(value))
            return F.lit(str(value)).cast(kind)
    except (ValueError, OverflowError, decimal.InvalidOperation):
        raise ValidationError(f"'{value}' is no {kind.simpleString()}") from None
    raise ValidationError(f"columns of type {kind.simpleString()} cannot be compared")


def pattern(value: Any) -> str:
    """A LIKE pattern in which the backslash stands before %, _ and itself only (elsewhere it quotes what needs none)."""
    if not isinstance(value, str):
        raise ValidationError("a pattern is no string")
    return re.sub(r"\\(.?)", lambda m: m[0] if m[1] and m[1] in "%_\\" else m[1] if m[1] else "\\\\", value, flags=re.DOTALL)


def test(column: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """One comparison, in three-valued logic: nothing equals null, and a null in a list of ``nin`` leaves no rows."""
    if op == "isNull":
        return column.isNull()
    if op == "isNotNull":
        return column.isNotNull()
    if op in ("like", "ilike"):
        if not isinstance(kind, T.StringType):
            column = column.cast("string")
        return column.like(pattern(value)) if op == "like" else column.ilike(pattern(value))
    if op in ("in", "nin"):
        if not value:
            return F.lit(op == "nin")
        inside = column.isin(*[literal(v, kind) for v in value])
        return inside if op == "in" else ~inside
    other = literal(value, kind)
    return {
        "eq": lambda: column == other, "ne": lambda: column != other, "gt": lambda: column > other,
        "gte": lambda: column >= other, "lt": lambda: column < other, "lte": lambda: column <= other,
    }[op]()


def predicate(x: Test | Logic, column: Callable[[str], Typed]) -> Column:
    """A whole filter; ``column`` gives the Column and type of a name."""
    if isinstance(x, Test):
        return test(*column(x.field), x.op, x.value)
    parts = [predicate(p, column) for p in x.parts]
    if x.op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if x.op == "and" else out | p
    return out


def identity(columns: list[Typed], value: Any) -> Column:
    """Equality with an id (of one field, or a list of as many as the entity has); what no id can be matches nothing."""
    values = list(value) if isinstance(value, list | tuple) else [value]
    if len(values) != len(columns):
        return F.lit(False)
    out = F.lit(True)
    for (column, kind), v in zip(columns, values, strict=True):
        try:
            out = out & (column == literal(v, kind))
        except ValidationError:
            return F.lit(False)
    return out
