"""Grouping, aggregates, tests of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.predicates import Typed, predicate
from treeline.plans.analyze import Node
from treeline.plans.wire import Aggregate


def aggregate(spec: Aggregate, column: Column | None) -> Column:
    if column is None:
        return F.count(F.lit(1))
    if spec.fn == "count":
        return F.count_distinct(column) if spec.distinct else F.count(column)
    if spec.fn == "sum":
        return F.sum_distinct(column) if spec.distinct else F.sum(column)
    if spec.fn == "avg":
        return F.sum_distinct(column).cast("double") / F.count_distinct(column) if spec.distinct else F.avg(column)
    return F.min(column) if spec.fn == "min" else F.max(column)


def grouped(df: DataFrame, node: Node, column: dict[str, Column]) -> DataFrame:
    """One row for each group (one row in all without keys): the keys, then the aggregates, after $having."""
    keys = [column[k].alias(k) for k in node.group]
    values = [aggregate(a, column[a.field] if a.field else None).alias(name) for name, a in node.aggregates.items()]
    if values:
        out = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    else:
        out = df.select(*keys).distinct()
    if node.having:
        out = out.filter(predicate(node.having, typed(out)))
    return out


def typed(df: DataFrame):
    """Column and type by name."""

    def column(name: str) -> Typed:
        return F.col(f"`{name}`"), df.schema[name].dataType

    return column
