"""Connected components of an edge table, by alternating large-star and small-star rounds over DataFrames.

Nothing is collected; each round is two aggregations and two joins, its result a written table.  Hubs are pre-aggregated
before the shuffle, and their rows meet a small broadcast instead of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import dropped, joined_by_group, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) in both directions, or with v < u only: the neighbours of each u, re-hung on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    least = written(least.select("u", F.least("u", "m").alias("m"), "degree"), "least")
    hung = joined_by_group(edges, least, "u", "degree")
    if large:
        return hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root on anything: then the edges name the components."""
    rows, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    if rows != nodes:
        return False
    return not rows or edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (columns a, b, both long) but the roots."""
    now = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, True).distinct(), "edges")
        following = written(_star(large, False).distinct(), "edges")
        dropped(now.sparkSession, now)
        dropped(now.sparkSession, large)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
