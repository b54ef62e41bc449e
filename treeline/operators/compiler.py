"""Plans to DataFrames: points, pages, whole sets, groups."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators.aggregation import grouped, typed
from treeline.operators.ordering import follows, sorted_by
from treeline.operators.predicates import identity
from treeline.operators.relations import Builder
from treeline.plans import cursor
from treeline.plans.analyze import Node
from treeline.schema import Schema
from treeline.sources.catalog import Catalog


@dataclass
class Compiled:
    """``rows``: the result's columns, and the order's values under ``keys``; sorted, one row more than the page."""

    rows: DataFrame
    keys: list[str]
    names: list[str]

    def shown(self, first: int | None = None) -> DataFrame:
        out = self.rows if first is None else self.rows.limit(first)
        return out.select(*[F.col(f"`{n}`") for n in self.names])


def compile_plan(plan: Node, schema: Schema, catalog: Catalog, point: Any = None, is_point: bool = False, eager: bool = False) -> Compiled:
    """The DataFrame of a plan, lazy.  With ``eager``, a page with relations is read at once (it is bounded), so that its
    keys reach the scans of what is attached as literals; else they reach it by a semi-join."""
    build = Builder(schema, catalog)
    prefix = build.prefix()
    df = build.filtered(build.scan(plan, prefix, build.wanted(plan, [])), plan, prefix)
    column = build.typed(df, plan, prefix)
    if plan.grouped:
        return _groups(plan, df, column)
    if is_point:
        df = df.filter(identity([column(f) for f in plan.config.ids], point)) if plan.config.ids else df.limit(0)
        df = build.completed(df, plan, [], prefix, True, [])
        return Compiled(df.select(*build.value(plan, prefix)), [], [*plan.fields, *[r.name for r in plan.refs]])
    if plan.distinct:
        by = Window.partitionBy(*[column(f)[0] for f in plan.distinct]).orderBy(*sorted_by(plan.order, column))
        df = df.withColumn(f"{prefix}#n", F.row_number().over(by)).filter(F.col(f"{prefix}#n") == 1).drop(f"{prefix}#n")
    if plan.after:
        df = df.filter(follows(plan.order, cursor.decode(plan.after, plan), column))
    paged = plan.first is not None
    if paged:
        df = df.orderBy(*sorted_by(plan.order, column)).limit(plan.first + 1)
        if eager and (plan.refs or build.hidden(plan)):
            page = df.collect()
            df = df.sparkSession.createDataFrame(page, df.schema)
            build.known = {c: [r[c] for r in page] for c in df.columns}
    df = build.completed(df, plan, [], prefix, paged, [])
    keys = [f"<{i}" for i in range(len(plan.order))]
    order = [column(s.field)[0].alias(k) for s, k in zip(plan.order, keys, strict=True)]
    if paged:
        df = df.orderBy(*sorted_by(plan.order, column))
    return Compiled(df.select(*order, *build.value(plan, prefix)), keys, [*plan.fields, *[r.name for r in plan.refs]])


def _groups(plan: Node, df: DataFrame, column: Any) -> Compiled:
    names = {a.field for a in plan.aggregates.values() if a.field} | set(plan.group)
    out = grouped(df, plan, {n: column(n)[0] for n in names})
    order = [s for s in plan.order if s.field in out.columns]
    if plan.after:
        out = out.filter(follows(plan.order, cursor.decode(plan.after, plan), typed(out)))
    if order and plan.first is not None:
        out = out.orderBy(*sorted_by(order, typed(out))).limit(plan.first + 1)
    keys = [f"<{i}" for i in range(len(order))]
    shown = [*plan.group, *plan.aggregates]
    return Compiled(out.select(*[F.col(f"`{s.field}`").alias(k) for s, k in zip(order, keys, strict=True)], *[F.col(f"`{n}`") for n in shown]), keys, shown)
