"""Mixing sources to target weights.

Words are summed for each source; the targets follow from the weights by water-filling under the cap; each document is
emitted floor(rate) times, plus once more with the probability of the fraction, drawn from a hash of its id.

Defined results:
- null or empty text has size 0 and is taken 0 words, whatever its copies;
- a null source is a source of its own, ordered last;
- a source of size 0 has target 0 and no copies;
- the draw depends on the seed and doc_id alone (on the text where doc_id is null), so reruns and any order of rows
  agree; repeated rows draw alike;
- an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import SPACES, fresh, hashed_unit, joined_by_group, text_or_empty, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Source tables of up to so many rows are broadcast; beyond, only the sources that hold much of the documents are.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> with target: shares of the whole by weight, none above ``cap`` times its own size.

    The level L with sum(min(L * weight, cap * size)) = total is found by prefix sums in order of cap * size / weight.
    One row for each source passes through one task; the number of sources doesn't grow with the documents.
    """
    every = Window.partitionBy()
    at = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int"))
    x = per_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    x = x.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    x = x.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("full", F.col("left") >= F.col("ratio") * F.col("open"))
    free = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    spare = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * spare / free)
    return x.select(*per_source.columns, target.alias("target"))


def per_source(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, rows, target of rows of source and size."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    return written(targets(sums, weights, cap), "targets")


def joined(rows: DataFrame, per: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with columns of their source's row in ``per``, under the names given."""
    (key, count) = fresh(rows, "source_key", "source_rows")
    code = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    per = per.select(code.alias(key), F.col("rows").alias(count), *[F.col(c).alias(n) for c, n in names.items()])
    rows = rows.withColumn(key, code)
    out = rows.join(F.broadcast(per), key) if per.count() <= BROADCAST_SOURCES else joined_by_group(rows, per, key, count)
    return out.drop(key, count)


def mixed(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of ``docs``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty().cast("binary")))
    sizes = written(
        docs.select("doc_id", "source", words(text_or_empty()).alias("size"), hashed_unit(seed, key).alias("draw")), "sizes"
    )
    out = joined(sizes, per_source(sizes, weights, cap), {"source_size": "source_size", "target": "target"})
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies")).drop("draw")


def emitted(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns as they are.

    The rates of the sources are joined to the documents and the draw is made in place; no text is shuffled.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty().cast("binary")))
    sizes = docs.select("source", words(text_or_empty()).alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each, copies, copy = fresh(docs, "mix_rate", "mix_copies", "mix_copy")
    out = joined(docs, per_source(sizes, weights, cap).withColumn("rate", rate), {"rate": each})
    count = F.floor(F.col(each)) + (hashed_unit(seed, key) < F.col(each) - F.floor(F.col(each))).cast("long")
    out = out.withColumn(copies, count.cast("int")).filter(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
