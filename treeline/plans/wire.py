"""The two query languages and the tree they share.

JSON carries selections and controls; the brace language carries selections alone: ``{ user { id tokens { value } } }``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from treeline.errors import ParseError

#: Fixed values of the protocol.
CONTROLS = ("$select", "$where", "$orderBy", "$page", "$distinct", "$groupBy", "$aggregate", "$having")
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "like", "ilike", "isNull", "isNotNull")
AGGREGATES = ("count", "sum", "avg", "min", "max")
DEFAULT_FIRST, MAX_FIRST = 50, 200
MAX_DEPTH, MAX_NODES, MAX_IN, MAX_KEYS, MAX_AGGREGATES = 8, 64, 200, 8, 16


@dataclass(frozen=True)
class Test:
    """A leaf of a filter; ``aggregate`` tells whether ``field`` names an aggregate."""

    field: str
    op: str
    value: Any = None
    aggregate: bool = False


@dataclass(frozen=True)
class Logic:
    """``and``, ``or`` or ``not`` (of one) over filters."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    nulls_first: bool = False
    aggregate: bool = False


@dataclass(frozen=True)
class Aggregate:
    fn: str
    field: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Page:
    first: int | None = None
    after: str | None = None


@dataclass
class Query:
    """A node as it was sent: selected names, True for a field or a Query for a relation, and the controls."""

    name: str
    select: dict[str, Any] = field(default_factory=dict)
    where: Test | Logic | None = None
    order: list[Sort] = field(default_factory=list)
    page: Page | None = None
    distinct: list[str] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    aggregates: dict[str, Aggregate] = field(default_factory=dict)
    having: Test | Logic | None = None


def parse_json(raw: str | dict) -> Query:
    """A query from JSON text (or what it decodes to); it has one root, and $-keys beside it are ignored."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ParseError(f"the query is no JSON: {e}") from None
    if not isinstance(raw, dict):
        raise ParseError("the query is no object")
    roots = [k for k in raw if not k.startswith("$")]
    if len(roots) != 1:
        raise ParseError(f"the query has {len(roots)} roots, not one")
    return _node(roots[0], raw[roots[0]])


def _node(name: str, raw: Any) -> Query:
    if not isinstance(raw, dict):
        raise ParseError(f"'{name}' is no object")
    if unknown := [k for k in raw if k not in CONTROLS]:
        raise ParseError(f"'{name}' has the unknown key '{unknown[0]}'; fields belong in $select")
    select = raw.get("$select")
    if not isinstance(select, dict) or not select:
        raise ParseError(f"'{name}' selects nothing")
    out = Query(name)
    for key, value in select.items():
        if key.startswith("$"):
            raise ParseError(f"'{key}' cannot be selected")
        if value is not True and not isinstance(value, dict):
            raise ParseError(f"'{name}.{key}' is neither true nor an object")
        out.select[key] = True if value is True else _node(key, value)
    if "$where" in raw:
        out.where = _filter(raw["$where"], "$where", aggregates=False)
    if "$having" in raw:
        out.having = _filter(raw["$having"], "$having", aggregates=True)
    if "$orderBy" in raw:
        out.order = [_sort(x) for x in _listed(raw["$orderBy"], "$orderBy")]
    if "$page" in raw:
        out.page = _page(raw["$page"])
    if "$distinct" in raw:
        out.distinct = _names(raw["$distinct"], "$distinct")
    if "$groupBy" in raw:
        out.group = _names(raw["$groupBy"], "$groupBy")
    if "$aggregate" in raw:
        out.aggregates = _aggregates(raw["$aggregate"])
    return out


def _listed(raw: Any, what: str) -> list:
    if not isinstance(raw, list) or not raw:
        raise ParseError(f"{what} is no list, or empty")
    return raw


def _names(raw: Any, what: str) -> list[str]:
    if any(not isinstance(x, str) or not x for x in _listed(raw, what)):
        raise ParseError(f"{what} holds something that is no name")
    return list(raw)


def _filter(raw: Any, what: str, aggregates: bool) -> Test | Logic:
    if not isinstance(raw, dict):
        raise ParseError(f"{what} holds something that is no object")
    for op in ("and", "or"):
        if op in raw:
            if len(raw) > 1:
                raise ParseError(f"{what}: '{op}' stands beside other keys")
            return Logic(op, tuple(_filter(x, what, aggregates) for x in _listed(raw[op], f"{what}: '{op}'")))
    if "not" in raw:
        if len(raw) > 1:
            raise ParseError(f"{what}: 'not' stands beside other keys")
        return Logic("not", (_filter(raw["not"], what, aggregates),))
    of_aggregate = aggregates and "aggregate" in raw
    name = raw.get("aggregate" if of_aggregate else "field")
    if not isinstance(name, str) or not name:
        raise ParseError(f"{what}: a test names no field")
    op = raw.get("op")
    if op not in OPERATORS:
        raise ParseError(f"{what}: unknown operator '{op}'")
    if op in ("isNull", "isNotNull"):
        return Test(name, op, None, of_aggregate)
    if "value" not in raw:
        raise ParseError(f"{what}: '{op}' has no value")
    value = raw["value"]
    if op in ("in", "nin"):
        if not isinstance(value, list):
            raise ParseError(f"{what}: '{op}' needs a list")
        value = tuple(value)
    for x in value if isinstance(value, tuple) else (value,):
        if x is not None and not isinstance(x, str | int | float | bool):
            raise ParseError(f"{what}: a value of '{op}' is no scalar")
    return Test(name, op, value, of_aggregate)


def _sort(raw: Any) -> Sort:
    if not isinstance(raw, dict):
        raise ParseError("$orderBy holds something that is no object")
    of_aggregate = "aggregate" in raw
    name = raw.get("aggregate" if of_aggregate else "field")
    if not isinstance(name, str) or not name:
        raise ParseError("$orderBy names no field")
    if raw.get("direction") not in ("asc", "desc"):
        raise ParseError(f"$orderBy: unknown direction '{raw.get('direction')}'")
    if raw.get("nulls", "last") not in ("first", "last"):
        raise ParseError(f"$orderBy: unknown placement of nulls '{raw['nulls']}'")
    return Sort(name, raw["direction"] == "desc", raw.get("nulls") == "first", of_aggregate)


def _page(raw: Any) -> Page:
    if not isinstance(raw, dict):
        raise ParseError("$page is no object")
    if unknown := [k for k in raw if k not in ("first", "after")]:
        raise ParseError(f"$page has the unknown key '{unknown[0]}'")
    first, after = raw.get("first"), raw.get("after")
    if "first" in raw and (not isinstance(first, int) or isinstance(first, bool) or first < 1):
        raise ParseError("$page.first is no whole number above 0")
    if after is not None and (not isinstance(after, str) or not after):
        raise ParseError("$page.after is no cursor")
    return Page(first, after)


def _aggregates(raw: Any) -> dict[str, Aggregate]:
    if not isinstance(raw, dict) or not raw:
        raise ParseError("$aggregate is no object, or empty")
    out = {}
    for alias, spec in raw.items():
        if not isinstance(spec, dict) or spec.get("fn") not in AGGREGATES:
            raise ParseError(f"$aggregate '{alias}' has no known function")
        name, distinct = spec.get("field"), spec.get("distinct", False)
        if name is not None and (not isinstance(name, str) or not name):
            raise ParseError(f"$aggregate '{alias}' has a field that is no name")
        if not isinstance(distinct, bool):
            raise ParseError(f"$aggregate '{alias}': distinct is neither true nor false")
        if name in (None, "*") and (spec["fn"] != "count" or distinct):
            raise ParseError(f"$aggregate '{alias}' needs a field")
        out[alias] = Aggregate(spec["fn"], None if name == "*" else name, distinct)
    return out


_TOKENS = re.compile(r"\s*(?:([{}])|([A-Za-z_][A-Za-z0-9_]*))")


def tokens(raw: str) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(raw.rstrip()):
        m = _TOKENS.match(raw, at)
        if not m:
            at += len(raw[at:]) - len(raw[at:].lstrip())
            raise ParseError(f"unexpected '{raw[at]}' at {at}")
        out.append((m[1] or m[2], m.start(1) if m[1] else m.start(2)))
        at = m.end()
    return out


def parse_braces(raw: str) -> Query:
    """A query from the brace language: one pass over the tokens with a stack of open nodes."""
    words = [*tokens(raw), ("", len(raw))]
    if words[0][0] != "{":
        raise ParseError("the query does not begin with '{'")
    top = Query("")
    stack, last = [top], None
    for word, at in words[1:]:
        if not stack:
            if word:
                raise ParseError(f"'{word}' at {at} comes after the end")
            break
        if not word:
            raise ParseError(f"a '{{' is not closed at {at}")
        if word == "{":
            if last is None:
                raise ParseError(f"'{{' at {at} follows no name")
            stack[-1].select[last] = child = Query(last)
            stack.append(child)
            last = None
        elif word == "}":
            if not stack[-1].select:
                raise ParseError(f"nothing is selected before {at}")
            stack.pop()
            last = None
        else:
            stack[-1].select.setdefault(word, True)
            last = word
    if len(top.select) != 1:
        raise ParseError(f"the query has {len(top.select)} roots, not one")
    (root,) = top.select.values()
    if root is True:
        raise ParseError("the root selects nothing")
    return root


def parse(raw: str | dict, form: str = "json") -> Query:
    parsers: dict[str, Callable] = {"json": parse_json, "ql": parse_braces}
    if form not in parsers:
        raise ParseError(f"unknown format '{form}'")
    return parsers[form](raw)


def to_json(query: Query) -> dict:
    """The JSON form of a query."""
    return {query.name: _wire(query)}


def _wire(q: Query) -> dict:
    def test(x: Test | Logic) -> dict:
        if isinstance(x, Logic):
            return {"not": test(x.parts[0])} if x.op == "not" else {x.op: [test(p) for p in x.parts]}
        out = {"aggregate" if x.aggregate else "field": x.field, "op": x.op}
        return out if x.op in ("isNull", "isNotNull") else out | {"value": list(x.value) if isinstance(x.value, tuple) else x.value}

    out: dict[str, Any] = {"$select": {k: True if v is True else _wire(v) for k, v in q.select.items()}}
    if q.where:
        out["$where"] = test(q.where)
    if q.order:
        out["$orderBy"] = [
            {"aggregate" if s.aggregate else "field": s.field, "direction": "desc" if s.descending else "asc", "nulls": "first" if s.nulls_first else "last"}
            for s in q.order
        ]
    if q.page:
        out["$page"] = {k: v for k, v in (("first", q.page.first), ("after", q.page.after)) if v is not None}
    for key, names in (("$distinct", q.distinct), ("$groupBy", q.group)):
        if names:
            out[key] = list(names)
    if q.aggregates:
        out["$aggregate"] = {k: {"fn": a.fn, "field": a.field or "*"} | ({"distinct": True} if a.distinct else {}) for k, a in q.aggregates.items()}
    if q.having:
        out["$having"] = test(q.having)
    return out


def to_braces(query: Query) -> str:
    """The brace form of a query without controls."""
    if query.where or query.order or query.page or query.distinct or query.group or query.aggregates or query.having:
        raise ParseError(f"'{query.name}' has controls, which the brace language lacks")

    def text(q: Query) -> str:
        return f"{q.name} {{ {' '.join(k if v is True else text(v) for k, v in q.select.items())} }}"

    return f"{{ {text(query)} }}"
