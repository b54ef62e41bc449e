"""From a query as sent to a plan checked against the schema."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from treeline.errors import ValidationError
from treeline.plans import wire
from treeline.plans.wire import Aggregate, Logic, Query, Sort, Test
from treeline.schema import Entity, Join, Schema


@dataclass
class Node:
    """A record set of the plan: what is selected of an entity, and what becomes of its rows."""

    name: str
    entity: str
    path: str
    config: Entity
    join: Join | None = None
    fields: list[str] = field(default_factory=list)
    refs: list[Node] = field(default_factory=list)
    where: Test | Logic | None = None
    order: list[Sort] = field(default_factory=list)
    first: int | None = None
    after: str | None = None
    distinct: list[str] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    aggregates: dict[str, Aggregate] = field(default_factory=dict)
    having: Test | Logic | None = None
    #: A predicate that access rules add; a filter like ``where``, but the client's limits don't hold for it.
    guard: Test | Logic | None = None
    #: The same for relations that only computed fields read, by name.
    hidden_guards: dict[str, Test | Logic] = field(default_factory=dict)

    @property
    def grouped(self) -> bool:
        return bool(self.group or self.aggregates)

    @property
    def many(self) -> bool:
        return self.join is None or self.join.many

    def computed(self) -> list[str]:
        return [f for f in self.fields if f in self.config.computed]

    def walk(self) -> Iterator[Node]:
        yield self
        for ref in self.refs:
            yield from ref.walk()

    def at(self, path: str) -> Node | None:
        """The node at a dotted path of relation names below this one; the empty path is this one."""
        node: Node | None = self
        for name in filter(None, path.split(".")):
            node = next((r for r in node.refs if r.name == name), None)
            if node is None:
                return None
        return node


@dataclass(frozen=True)
class Options:
    """``nested_first``: a page size for to-many relations that name none (None: all children)."""

    default_first: int = wire.DEFAULT_FIRST
    max_first: int = wire.MAX_FIRST
    nested_first: int | None = None


def tests(x: Test | Logic | None) -> Iterator[Test]:
    if isinstance(x, Test):
        yield x
    elif x is not None:
        for part in x.parts:
            yield from tests(part)


def _sizes(x: Test | Logic) -> tuple[int, int]:
    """Depth and count of nodes of a filter."""
    if isinstance(x, Test):
        return 1, 1
    inner = [_sizes(p) for p in x.parts]
    return 1 + max(d for d, _ in inner), 1 + sum(n for _, n in inner)


def _limit_filter(x: Test | Logic | None, what: str) -> None:
    if x is None:
        return
    depth, count = _sizes(x)
    if depth > wire.MAX_DEPTH:
        raise ValidationError(f"{what} is deeper than {wire.MAX_DEPTH}")
    if count > wire.MAX_NODES:
        raise ValidationError(f"{what} has more than {wire.MAX_NODES} parts")
    for t in tests(x):
        if t.op in ("in", "nin") and len(t.value) > wire.MAX_IN:
            raise ValidationError(f"{what}: a list of '{t.op}' has more than {wire.MAX_IN} values")


def analyze(query: Query, schema: Schema, options: Options | None = None, paged: bool = True) -> Node:
    """The plan of a collection read (``paged``) or of a point read."""
    options = options or Options()
    entity = schema.resolve(query.name)
    if entity is None:
        raise ValidationError(f"unknown entity '{query.name}'")
    root = _node(query, entity, "", None, schema, options)
    if root.grouped:
        if root.refs:
            raise ValidationError("a grouped read selects no relations")
    elif query.having:
        raise ValidationError("$having needs $groupBy or $aggregate")
    if paged:
        page = query.page or wire.Page()
        root.first, root.after = _first(page, options.default_first, options), page.after
    root.order = _tied(root)
    return root


def _first(page: wire.Page, default: int | None, options: Options) -> int | None:
    first = default if page.first is None else page.first
    if first is not None and first > options.max_first:
        raise ValidationError(f"$page.first is {first}, more than {options.max_first}")
    return first


def _node(query: Query, entity: str, path: str, join: Join | None, schema: Schema, options: Options) -> Node:
    config = schema.entities[entity]
    where = f"'{path or entity}'"
    node = Node(path.rpartition(".")[2] or entity, entity, path, config, join)
    nested = join is not None
    if nested and (query.distinct or query.group or query.aggregates or query.having):
        raise ValidationError(f"$distinct, $groupBy, $aggregate and $having are for the root, not for {where}")
    if nested and not join.many and (query.where or query.order or query.page):
        raise ValidationError(f"$where, $orderBy and $page are for many records; {where} is one")
    if nested and query.page and query.page.after:
        raise ValidationError(f"$page.after is for the root, not for {where}")
    # a path below the root names joins by the relation's own name first
    own_name = node.name if nested else entity
    for name, value in query.select.items():
        if value is True:
            if name not in config.fields and name not in config.computed:
                raise ValidationError(f"unknown field '{name}' of {where}")
            node.fields.append(name)
            continue
        found = schema.join(own_name, entity, name)
        if found is None:
            raise ValidationError(f"unknown relation '{name}' of {where}")
        _, edge = found
        child = f"{path}.{name}" if path else name
        node.refs.append(_node(value, edge.entity, child, edge, schema, options))
    for what, x in (("$where", query.where), ("$having", query.having)):
        _limit_filter(x, f"{what} of {where}")
    if len(query.group) > wire.MAX_KEYS:
        raise ValidationError(f"$groupBy has more than {wire.MAX_KEYS} keys")
    if len(query.aggregates) > wire.MAX_AGGREGATES:
        raise ValidationError(f"$aggregate has more than {wire.MAX_AGGREGATES} entries")
    for t in tests(query.where):
        _physical(t.field, node, "$where")
    for names, what in ((query.distinct, "$distinct"), (query.group, "$groupBy")):
        for name in names:
            _physical(name, node, what)
        if len(set(names)) < len(names):
            raise ValidationError(f"{what} of {where} names a field twice")
    for alias, a in query.aggregates.items():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", alias):
            raise ValidationError(f"$aggregate: '{alias}' is no name")
        if alias in query.group:
            raise ValidationError(f"$aggregate: '{alias}' is also a key of $groupBy")
        if a.field:
            _physical(a.field, node, "$aggregate")
    grouped = bool(query.group or query.aggregates)
    for t in tests(query.having):
        if t.field not in (query.aggregates if t.aggregate else query.group):
            raise ValidationError(f"$having: '{t.field}' is no {'aggregate' if t.aggregate else 'key of $groupBy'}")
    for s in query.order:
        if s.aggregate or grouped:
            if s.field not in query.aggregates and (s.aggregate or s.field not in query.group):
                raise ValidationError(f"$orderBy: '{s.field}' is neither grouped nor aggregated")
        else:
            _physical(s.field, node, "$orderBy")
    if grouped and query.distinct:
        raise ValidationError("$distinct doesn't go with $groupBy or $aggregate")
    if grouped:  # what is selected beside the keys has no value in a group
        node.fields = [f for f in node.fields if f in query.group]
    node.where, node.having, node.distinct = query.where, query.having, list(query.distinct)
    node.group, node.aggregates, node.order = list(query.group), dict(query.aggregates), list(query.order)
    if nested and join.many:
        node.first = _first(query.page or wire.Page(), options.nested_first, options)
        if node.order or node.first:
            node.order = _tied(node)
    return node


def _physical(name: str, node: Node, what: str) -> None:
    if name in node.config.computed:
        raise ValidationError(f"{what}: '{name}' of '{node.entity}' is computed, and can only be selected")
    if name not in node.config.fields and name not in node.config.ids:
        raise ValidationError(f"{what}: unknown field '{name}' of '{node.entity}'")


def _tied(node: Node) -> list[Sort]:
    """The order made total: by id, or by the keys of the groups, or (without an id) by all fields."""
    names = {s.field for s in node.order}
    if node.grouped:
        more = node.group
    else:
        more = node.config.ids or node.config.fields
    return node.order + [Sort(n) for n in more if n not in names]


def scope(node: Node) -> str:
    """A digest of what a cursor must agree on; equal queries give equal digests, however they were written."""

    def plain(x: object) -> object:
        if isinstance(x, Test | Logic | Sort | Aggregate):
            return [type(x).__name__, *[plain(getattr(x, k)) for k in x.__dataclass_fields__]]
        if isinstance(x, list | tuple):
            return [plain(y) for y in x]
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return x

    told = [node.entity, node.path, node.where, node.guard, node.order, node.distinct, node.group, node.aggregates, node.having, node.grouped]
    return hashlib.sha256(json.dumps(plain(told), sort_keys=True, default=str).encode()).hexdigest()[:16]


def summary(node: Node) -> dict:
    """What a plan does, for traces."""
    return {
        "entity": node.entity, "path": node.path, "mode": "aggregate" if node.grouped else "record", "fields": list(node.fields),
        "joins": [{"path": n.path, "entity": n.entity, "type": "many" if n.many else "one"} for n in node.walk() if n.path],
        "order": [f"{s.field} {'desc' if s.descending else 'asc'}" for s in node.order], "first": node.first,
    }


def both(a: Test | Logic | None, b: Test | Logic | None) -> Test | Logic | None:
    return a if b is None else b if a is None else Logic("and", (a, b))


def copied(node: Node, **changes: object) -> Node:
    return replace(node, **changes)
