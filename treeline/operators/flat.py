"""Flat joined rows, one column for each field of the plan, and back: nested records from flat rows.

Resolvers that know only joins return the first form.  Aliases are ``entity_field`` for the root and ``a_b_field`` below
the path ``a.b``; ids are always there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from treeline.errors import SchemaError
from treeline.operators.relations import Builder, link
from treeline.plans.analyze import Node
from treeline.schema import Schema
from treeline.sources.catalog import Catalog

#: Where a relation multiplies rows, so many of its rows for a key make a block, which is joined for itself.
BLOCK = 256


def alias(node: Node, name: str) -> str:
    return f"{node.path.replace('.', '_') or node.entity}_{name}"


def columns(node: Node) -> list[str]:
    """The logical fields of a node in flat rows: its ids, what is selected, what its computed fields need of itself."""
    names = [*node.config.ids, *[f for f in node.fields if f not in node.config.computed]]
    names += [s for c in node.computed() for s in node.config.computed[c].sources if "." not in s]
    return list(dict.fromkeys(names))


def multiplied(df: DataFrame, rows: DataFrame, mine: list[str], theirs: list[str], own: str) -> DataFrame:
    """``df`` left-joined with ``rows``, of which a key may have many in both.

    Joined by the key alone, the product would be left to a task for each key, or to one task where ``rows`` is small.
    So the rows of a key are cut into blocks, a row of ``df`` goes to each block of its key, and blocks are dealt out.
    """
    spark, block, at = df.sparkSession, f"{own}#block", f"{own}#at"
    keys, places = [F.col(f"`{k}`") for k in theirs], [f"{own}#k{i}" for i in range(len(theirs))]
    order = [F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    for k in keys:
        rows = rows.filter(k.isNotNull())
    blocks = rows.groupBy(*[k.alias(p) for k, p in zip(keys, places, strict=True)]).agg(F.floor((F.count(F.lit(1)) - 1) / BLOCK).alias(at))
    blocks = blocks.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(at))))
    rows = rows.withColumn(block, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys))) - 1) / BLOCK))
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    on, same = F.lit(True), F.col(at) == F.col(block)
    for m, p, k in zip(mine, places, keys, strict=True):
        on, same = on & (F.col(f"`{m}`") == F.col(p)), same & (F.col(p) == k)
    df = df.join(blocks, on, "left").repartition(many, *places, at)
    return df.join(rows.repartition(many, *keys, block), same, "left")


def flat(plan: Node, schema: Schema, catalog: Catalog) -> DataFrame:
    """The plan's rows, left-joined: the product of its to-many relations."""
    build = Builder(schema, catalog)
    out: list[Column] = []
    seen: set[str] = set()
    #: The to-many relations joined so far: one more that isn't below them all multiplies.
    joined: list[int] = []

    def take(node: Node, prefix: str) -> None:
        for name in columns(node):
            if (a := alias(node, name)) in seen:
                raise SchemaError(f"two fields are called '{a}' in flat rows")
            seen.add(a)
            out.append(F.col(f"`{prefix}{node.config.column(name)}`").alias(a))

    def join(df: DataFrame, node: Node, above: list[tuple[Node, str]]) -> DataFrame:
        take(node, above[0][1])
        for child in node.refs:
            found = link(child, [n for n, _ in above], schema)
            own, through = build.prefix(), child.join.through
            wanted = build.wanted(child, [n for n, _ in above]) | (set() if through else {c for _, _, c in found.pairs})
            rows = build.filtered(build.scan(child, own, wanted), child, own)
            if through:
                pairs = catalog.table(through.table).select(F.col(through.source).alias(f"{own}#0"), F.col(through.target).alias(f"{own}#to"))
                rows = pairs.join(rows, F.col(f"{own}#to") == F.col(f"`{own}{child.config.column(child.config.ids[0])}`"))
            mine = [f"{above[level][1]}{column}" for level, column, _ in found.pairs]
            theirs = [f"{own}#0"] if through else [f"{own}{column}" for _, _, column in found.pairs]
            if child.many and any(n not in [id(a) for a, _ in above] for n in joined):
                df = multiplied(df, rows, mine, theirs, own)
            else:
                on = F.lit(True)
                for m, t in zip(mine, theirs, strict=True):
                    on = on & (F.col(f"`{m}`") == F.col(f"`{t}`"))
                df = df.join(rows, on, "left")
            if child.many:
                joined.append(id(child))
            df = join(df, child, [(child, own), *above])
        return df

    prefix = build.prefix()
    df = build.filtered(build.scan(plan, prefix, build.wanted(plan, [])), plan, prefix)
    df = join(df, plan, [(plan, prefix)])
    return df.select(*out)


def chained(nodes: list[Node]) -> Node:
    """The plan that has of each node only the next as its relation."""
    return replace(nodes[0], refs=[chained(nodes[1:])] if nodes[1:] else [])


def nest(rows: DataFrame | Callable[[Node], DataFrame], plan: Node) -> DataFrame:
    """Nested records of flat rows: repeated records merge by id (records without an id are kept, one for each row),
    null ids are none, to-many relations become arrays ordered by id.  Columns: the root's ids under ``<``, then the
    result.  Of a function, which gives the rows of a plan, each node asks the rows of its own chain of relations, so that
    the product of several is never made."""
    frames: dict[str, DataFrame] = {}

    def ask(node: Node, above: list[Node]) -> None:
        frames[node.path] = rows if isinstance(rows, DataFrame) else rows(chained([*above, node]))
        for child in node.refs:
            ask(child, [*above, node])

    ask(plan, [])
    have = {c for df in frames.values() for c in df.columns}

    def ids(node: Node) -> list[str]:
        return [a for f in node.config.ids if (a := alias(node, f)) in have]

    def fields(node: Node) -> list[Column]:
        out = []
        for f in node.fields:
            if f in node.config.computed:
                spec = node.config.computed[f]
                out.append(spec.compute({s: F.col(f"`{alias(node, s)}`") for s in spec.sources}).alias(f))
            else:
                out.append(F.col(f"`{alias(node, f)}`").alias(f))
        return out

    def once(node: Node, mine: list[str]) -> DataFrame:
        """The rows that differ in what ``node`` reads, told apart by hash, as merging records sorts them.  Maps can't be
        compared, and a distinct -0.0 comes back as 0.0: with such columns all rows go on."""
        df = frames[node.path]
        read = [alias(node, s) for f in node.fields for s in (node.config.computed[f].sources if f in node.config.computed else (f,))]
        read = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*mine, *read])])
        return read if any(k in f.dataType.simpleString() for f in read.schema for k in ("map<", "variant", "float", "double")) else read.distinct()

    def built(node: Node, keys: list[str]) -> DataFrame:
        """One row for each record of ``node`` below ``keys``: keys, own ids, the record as ``@path``."""
        own = ids(node)
        mine = [*keys, *own]
        df = once(node, mine) if own and isinstance(rows, DataFrame) else frames[node.path]
        base = df.select(*[F.col(f"`{k}`") for k in mine], F.struct(*fields(node), F.lit(0).alias("<")).alias("@"))
        if own:
            base = base.filter(F.col(f"`{own[0]}`").isNotNull()).dropDuplicates(mine)
        for child in node.refs:
            got = built(child, mine)
            name = f">{child.name}"
            order = [F.col(f"`{k}`") for k in ids(child)]
            packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("@").alias("v"))
            if child.many:
                got = got.groupBy(*mine).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["v"]).alias(name))
            else:
                got = got.groupBy(*mine).agg(F.min(packed)["v"].alias(name))
            marks = [f"<k{i}" for i in range(len(mine))]
            got = got.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(mine, marks, strict=True)], F.col(f"`{name}`"))
            on = F.lit(True)
            for k, m in zip(mine, marks, strict=True):
                on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{m}`"))
            base = base.join(got, on, "left").drop(*marks)
            value = F.coalesce(F.col(f"`{name}`"), F.array().cast(got.schema[name].dataType)) if child.many else F.col(f"`{name}`")
            base = base.withColumn("@", F.col("@").withField(f"`{child.name}`", value)).drop(name)
        return base.withColumn("@", F.col("@").dropFields("`<`"))

    out = built(plan, [])
    names = [*plan.fields, *[r.name for r in plan.refs]]
    return out.select(*[F.col(f"`{k}`").alias(f"<{k}") for k in ids(plan)], *[F.col("@").getField(n).alias(n) for n in names])
