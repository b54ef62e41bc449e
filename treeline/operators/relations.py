"""Records of related entities as structs and arrays of structs.

Each relation is built for itself, deepest first, and aggregated to one row for each parent key before it is joined, so
two to-many relations of a parent never multiply.  Where the parents are few (a page, a point read), their keys filter
the children before they are aggregated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.errors import SchemaError
from treeline.operators.ordering import sorted_by
from treeline.operators.predicates import Typed, literal, predicate
from treeline.plans.analyze import Node, tests
from treeline.schema import Schema
from treeline.sources.catalog import Catalog

_EQUAL = re.compile(r"\s*([\w.]+)\.(\w+)\s*=\s*([\w.]+)\.(\w+)\s*\Z")


@dataclass
class Link:
    """How a child finds its parents: pairs of physical columns, from the direct parent (level 0) or further up."""

    pairs: list[tuple[int, str, str]]
    rest: list[str] = field(default_factory=list)


def link(node: Node, above: list[Node], schema: Schema) -> Link:
    """The key pairs in a join's condition; ``above``: the parent first, the root last.

    What is no equality with something above may test the child alone.
    """
    join = node.join
    parent = above[0]
    if join.through:
        ids = [parent.config.column(f) for f in parent.config.ids]
        if len(ids) != 1 or len(node.config.ids) != 1:
            raise SchemaError(f"'{node.path}': a junction needs ids of one field")
        return Link([(0, ids[0], join.through.source)])
    names = [{"child", node.entity, node.name, join.table or schema.table(node.entity), schema.table(node.entity)}]
    names += [{*(["parent"] if i == 0 else []), n.entity, n.name, schema.table(n.entity)} for i, n in enumerate(above)]
    pairs, rest = [], []
    for clause in re.split(r"\s+AND\s+", join.on.strip(), flags=re.I):
        m = _EQUAL.match(clause.strip("() "))
        if not m:
            rest.append(clause)
            continue
        left, right = ([i for i, known in enumerate(names) if q in known] for q in (m[1], m[3]))
        if "parent" in (m[1], m[3]) or "child" in (m[1], m[3]):  # the words decide, whatever the tables are called
            left = [1] if m[1] == "parent" else [0] if m[1] == "child" else left
            right = [1] if m[3] == "parent" else [0] if m[3] == "child" else right
        if not left or not right:
            raise SchemaError(f"'{node.path}': '{clause.strip()}' names a table that isn't joined")
        if m[1] == m[3] and {0, 1} <= set(left):
            raise SchemaError(f"'{node.path}': '{clause.strip()}' joins a table to itself; say parent. and child.")
        if 0 in left and 0 in right:
            left, right = ([0], [x for x in right if x]) if m[1] in (node.name, "child") else ([x for x in left if x], [0])
        if 0 in left and right:
            pairs.append((right[0] - 1, m[4], m[2]))
        elif 0 in right and left:
            pairs.append((left[0] - 1, m[2], m[4]))
        else:
            raise SchemaError(f"'{node.path}': '{clause.strip()}' doesn't join the child to anything above it")
    if not pairs:
        raise SchemaError(f"'{node.path}': the condition has no equality with the parent")
    return Link(pairs, rest)


class Builder:
    """Builds the rows of nodes; every physical column gets its node's prefix, so names never clash."""

    def __init__(self, schema: Schema, catalog: Catalog):
        self.schema, self.catalog, self.count = schema, catalog, 0
        #: Values of the page's columns, where the page was read already: at most a page and a row of them.
        self.known: dict[str, list] = {}

    def prefix(self) -> str:
        self.count += 1
        return f"t{self.count}_"

    def scan(self, node: Node, prefix: str, wanted: set[str]) -> DataFrame:
        table = self.catalog.table((node.join and node.join.table) or self.schema.table(node.entity))
        if missing := sorted(wanted - set(table.columns)):
            raise SchemaError(f"table of '{node.entity}' has no column '{missing[0]}'")
        return table.select(*[F.col(f"`{c}`").alias(prefix + c) for c in sorted(wanted)])

    def typed(self, df: DataFrame, node: Node, prefix: str):
        def column(name: str) -> Typed:
            own = prefix + node.config.column(name)
            return F.col(f"`{own}`"), df.schema[own].dataType

        return column

    def hidden(self, node: Node) -> dict[str, set[str]]:
        """By relation, the fields that selected computed fields need from it."""
        out: dict[str, set[str]] = {}
        for name in node.computed():
            for source in node.config.computed[name].sources:
                if "." in source:
                    ref, _, f = source.partition(".")
                    out.setdefault(ref, set()).add(f)
        return out

    def children(self, node: Node) -> list[tuple[Node, set[str], bool]]:
        """The relations to attach: with the fields that only computed ones need, and whether they are in the result."""
        hidden = self.hidden(node)
        out = [(ref, hidden.pop(ref.name, set()), True) for ref in node.refs]
        for name, fields in hidden.items():
            _, join = self.schema.join(node.name if node.path else node.entity, node.entity, name)
            path = f"{node.path}.{name}" if node.path else name
            out.append((Node(name, join.entity, path, self.schema.entities[join.entity], join, guard=node.hidden_guards.get(name)), fields, False))
        return out

    def wanted(self, node: Node, above: list[Node], extra: set[str] = frozenset()) -> set[str]:
        """The physical columns that a node's rows need."""
        names = {f for f in node.fields if f not in node.config.computed} | set(node.config.ids) | set(extra) | set(node.distinct) | set(node.group)
        names |= {t.field for x in (node.where, node.guard) for t in tests(x)} | {s.field for s in node.order if not node.grouped}
        names |= {a.field for a in node.aggregates.values() if a.field}
        names |= {s for c in node.computed() for s in node.config.computed[c].sources if "." not in s}
        out = {node.config.column(n) for n in names}
        for child, _, _ in self.children(node):
            out |= self._asked(child, [node, *above], 0)
        return out

    def _asked(self, child: Node, above: list[Node], level: int) -> set[str]:
        """Columns of the node ``level`` steps above ``child`` that it or anything below it joins by."""
        out = {column for at, column, _ in link(child, above, self.schema).pairs if at == level}
        for below, _, _ in self.children(child):
            out |= self._asked(below, [child, *above], level + 1)
        return out

    def filtered(self, df: DataFrame, node: Node, prefix: str) -> DataFrame:
        for x in (node.guard, node.where):
            if x is not None:
                df = df.filter(predicate(x, self.typed(df, node, prefix)))
        return df

    def value(self, node: Node, prefix: str, extra: set[str] = frozenset()) -> list[Column]:
        """A node's result: its fields in the order selected, then its relations; then what only parents need."""
        out = [F.col(f"`{prefix}={f}`" if f in node.config.computed else f"`{prefix}{node.config.column(f)}`").alias(f) for f in node.fields]
        for ref, fields, shown in self.children(node):
            if shown:
                c = F.col(f"`{prefix}>{ref.name}`")
                out.append((c.dropFields(*[f"`<{f}`" for f in sorted(fields)]) if fields else c).alias(ref.name))
        return out + [F.col(f"`{prefix}{node.config.column(f)}`").alias(f"<{f}") for f in sorted(extra)]

    def completed(self, df: DataFrame, node: Node, above: list[Node], prefix: str, few: bool, prefixes: list[str]) -> DataFrame:
        """``df`` with its relations and computed fields; ``few``: its keys should filter what is attached."""
        for child, fields, _ in self.children(node):
            df = self.attached(df, node, child, [node, *above], prefix, fields, few, [prefix, *prefixes])
        for name in node.computed():
            spec = node.config.computed[name]
            have = {}
            for s in spec.sources:
                ref, _, f = s.partition(".")
                have[s] = F.col(f"`{prefix}>{ref}`").getField(f"<{f}") if f else F.col(f"`{prefix}{node.config.column(s)}`")
            c = spec.compute(have)
            df = df.withColumn(f"{prefix}={name}", c.cast({"string": "string", "number": "double", "boolean": "boolean"}[spec.type]) if spec.type else c)
        return df

    def attached(self, df: DataFrame, node: Node, child: Node, above: list[Node], prefix: str, fields: set[str], few: bool, prefixes: list[str]) -> DataFrame:
        """``df`` with the column ``prefix>name``: the child as a struct, or as an array of structs."""
        found = link(child, above, self.schema)
        own = self.prefix()
        mine = [f"{prefixes[level]}{column}" for level, column, _ in found.pairs]
        through = child.join.through
        wanted = self.wanted(child, above, fields) | (set() if through else {c for _, _, c in found.pairs})
        wanted |= {c for r in found.rest for c in self._rest_columns(r, child)}
        carried = [c for c in mine if c not in df.columns]
        if carried:
            raise SchemaError(f"'{child.path}' joins by '{carried[0]}', which its parent doesn't carry")
        rows = self.filtered(self.scan(child, own, wanted), child, own)
        for r in found.rest:
            rows = rows.filter(F.expr(self._rest(r, child, own)))
        if through:
            pairs = self.catalog.table(through.table).select(F.col(through.source).alias(f"{own}#0"), F.col(through.target).alias(f"{own}#to"))
            pairs = pairs.filter(F.col(f"{own}#0").isNotNull() & F.col(f"{own}#to").isNotNull())
            pairs = self._among(pairs, df, mine, [f"{own}#0"], few)
            if child.many and child.order:  # else the aggregation below takes each child once
                pairs = pairs.distinct()
            rows = pairs.join(rows, F.col(f"{own}#to") == F.col(f"`{own}{child.config.column(child.config.ids[0])}`"))
            keys = [f"{own}#0"]
        else:
            keys = [f"{own}#{i}" for i in range(len(mine))]
            rows = rows.select("*", *[F.col(f"`{own}{c}`").alias(k) for k, (_, _, c) in zip(keys, found.pairs, strict=True)])
            for k in keys:
                rows = rows.filter(F.col(f"`{k}`").isNotNull())
            rows = self._among(rows, df, mine, keys, few)
        rank = f"{own}#rank"
        if child.many and child.order:
            by = Window.partitionBy(*keys).orderBy(*sorted_by(child.order, self.typed(rows, child, own)))
            rows = rows.withColumn(rank, F.row_number().over(by))
            if child.first:
                rows = rows.filter(F.col(rank) <= child.first)
        # further ancestors' keys that grandchildren join by travel along with the child's rows
        up = sorted({(level, column) for below, _, _ in self.children(child) for level, column in self._further(below, [child, *above])})
        if up:
            lead = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(mine, keys, strict=True)], *[F.col(f"`{prefixes[level - 1]}{column}`") for level, column in up]).distinct()
            rows = rows.join(lead, keys)
            keys_all = keys + [f"{prefixes[level - 1]}{column}" for level, column in up]
            mine_all = mine + [f"{prefixes[level - 1]}{column}" for level, column in up]
        else:
            keys_all, mine_all = keys, mine
        rows = self.completed(rows, child, above, own, few, prefixes)
        payload = F.struct(*self.value(child, own, fields))
        ids = [F.col(f"`{own}{child.config.column(f)}`") for f in child.config.ids]
        out = f"{prefix}>{child.name}"
        renamed = [f"{own}#k{i}" for i in range(len(keys_all))]
        if child.many:
            place = [F.col(rank)] if child.order else ids
            packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(place)], payload.alias("v"))
            got = rows.groupBy(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys_all, renamed, strict=True)]).agg(
                F.transform(F.array_sort((F.collect_set if through else F.collect_list)(packed)), lambda x: x["v"]).alias(out)
            )
        elif {c for _, _, c in found.pairs} == {child.config.column(f) for f in child.config.ids} and not through and len(keys_all) == len(keys):
            got = rows.select(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys_all, renamed, strict=True)], payload.alias(out))
        else:
            least = F.struct(*ids) if ids else payload
            got = rows.groupBy(*[F.col(f"`{k}`").alias(r) for k, r in zip(keys_all, renamed, strict=True)]).agg(F.min_by(payload, least).alias(out))
        on = None
        for i, (m, r) in enumerate(zip(mine_all, renamed, strict=True)):
            same = F.col(f"`{m}`") == F.col(r) if i < len(mine) else F.col(f"`{m}`").eqNullSafe(F.col(r))
            on = same if on is None else on & same
        df = df.join(got, on, "left").drop(*renamed)
        if child.many:
            df = df.withColumn(out, F.coalesce(F.col(f"`{out}`"), F.array().cast(df.schema[out].dataType)))
        return df

    def _further(self, child: Node, above: list[Node], depth: int = 1) -> set[tuple[int, str]]:
        """(level above ``above[0]``, column) that ``child`` and those below it join by beyond their parent ``above[0]``."""
        out = {(level - depth + 1, column) for level, column, _ in link(child, above, self.schema).pairs if level >= depth}
        for below, _, _ in self.children(child):
            out |= self._further(below, [child, *above], depth + 1)
        return out

    def _among(self, rows: DataFrame, df: DataFrame, mine: list[str], keys: list[str], few: bool) -> DataFrame:
        """``rows`` whose keys are among those of ``df``, where that pays."""
        if not few:
            return rows
        if len(mine) == 1 and mine[0] in self.known:
            kind = rows.schema[keys[0]].dataType
            values = {v for v in self.known[mine[0]] if v is not None}
            return rows.filter(F.col(keys[0]).isin(*[literal(_told(v), kind) for v in values])) if values else rows.limit(0)
        asked = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(mine, keys, strict=True)]).distinct()
        return rows.join(asked, keys, "left_semi")

    def _rest_columns(self, clause: str, child: Node) -> set[str]:
        names = {"child", child.entity, child.name, child.join.table or self.schema.table(child.entity)}
        found = re.findall(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)", re.sub(r"'[^']*'", "''", clause))
        if other := [q for q, _ in found if q not in names]:
            raise SchemaError(f"'{child.path}': '{clause.strip()}' may only test the child, not '{other[0]}'")
        return {c for _, c in found}

    def _rest(self, clause: str, child: Node, prefix: str) -> str:
        parts = re.split(r"('[^']*')", clause)
        parts[::2] = [re.sub(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)", lambda m: f"`{prefix}{m[2]}`", p) for p in parts[::2]]
        return "".join(parts)


def _told(value):
    return value.isoformat(sep=" ") if hasattr(value, "isoformat") and hasattr(value, "hour") else value.isoformat() if hasattr(value, "isoformat") else value
