"""Exact dedup by a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each text ever seen, with the batch that brought
it.  A batch is reduced to one row for each digest and meets the index by a sort-merge join on the bucket column: the
index side is not shuffled.  (Spark sorts a bucket again where it has several files; ``compact`` leaves one for each.)
What the index lacks, by a sort-merge anti-join, is appended.

A batch may be named.  Rows that a batch of the same name left in the index, by an attempt that failed later on, count
as its own: running it again gives the same result and appends nothing twice.  One writer at a time.

Defined results:
- null text counts as empty; all empty texts (and all texts of white space) are equal to each other, as normalised;
- ties: the smallest doc_id stays; a null doc_id sorts last, so it stays only where every id of the group is null;
- repeated rows (same doc_id and equal text) are one document: one row in the result, each counted in group_size;
- an empty table gives an empty result and leaves the index as it was;
- further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import SPACES, fresh, joined_by_group, long_id, text_or_empty, written


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text, f"[{SPACES}]+", " ").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n: the documents with how many rows each has, as a scratch table."""
    slim = docs.select(long_id(docs).alias("doc_id"), digest(text_or_empty()).alias("digest"))
    return written(slim.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by digest, that outlives the run that made it."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        """``path``: where the table's files are; with it, a new session finds the index again."""
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            at = f" LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}"
            )

    def drop(self) -> None:
        """Deletes the index; results that ``dedup`` gave stay as they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _save(self, rows: DataFrame, name: str, mode: str) -> None:
        rows = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode(mode).saveAsTable(name)

    def compact(self) -> None:
        """Rewrites the index (one without a path) with one file for each bucket."""
        self._save(self.rows(), f"{self.name}_next", "overwrite")
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The groups whose digests the index has not."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str | None = None) -> None:
        """Appends the digests that the index lacks."""
        self._save(self.lacking(groups).withColumn("batch", F.lit(batch or uuid.uuid4().hex)), self.name, "append")

    def groups(self, one: DataFrame, batch: str | None = None) -> DataFrame:
        """digest, group_size (rows of this batch), seen (by another batch), keep_id of each text among ``digests``; the
        new ones join the index."""
        per = one.groupBy("digest").agg(F.min("doc_id").alias("own_id"), F.sum("n").alias("group_size"))
        old = self.rows().filter(~F.col("batch").eqNullSafe(F.lit(batch)) if batch else F.lit(True))
        old = old.select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("seen")).hint("merge")
        groups = written(
            per.join(old, "digest", "left").select(
                "digest", "group_size", F.coalesce("seen", F.lit(False)).alias("seen"),
                F.when(F.col("seen"), F.col("old_id")).otherwise(F.col("own_id")).alias("keep_id"),
            ), "groups",
        )
        self.append(groups.filter(~F.col("seen")), batch)
        return groups

    def dedup(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, text_sha256, keep_id, group_size (rows of this batch), kept; the batch's new texts join the index.

        A text that another batch brought keeps that batch's keep_id, and no row of this batch is kept for it.
        """
        one = digests(docs)
        return answered(one, self.groups(one, batch))


def answered(one: DataFrame, groups: DataFrame) -> DataFrame:
    both = joined_by_group(one.select("digest", "doc_id"), groups, "digest", "group_size")
    return both.select(
        "doc_id", "keep_id", "group_size",
        (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Each document with the one that stays for its text; against an index of this call's own where none is given.

    Then the documents come in two batches, the lower half of the range of ids first: what the index holds when the
    second comes has the lesser ids, so the least id of all stays.
    """
    if index is not None:
        return index.dedup(docs, batch)
    one = digests(docs)
    low, high = one.agg(F.min("doc_id"), F.max("doc_id")).first()
    half = (low + high) // 2 if low is not None else 0
    own = DigestIndex(docs.sparkSession, f"digests_{uuid.uuid4().hex[:12]}")
    first = own.groups(one.filter(F.col("doc_id") <= half), "first")
    second = own.groups(one.filter(F.col("doc_id").isNull() | (F.col("doc_id") > half)), "second")
    own.drop()
    both = first.unionByName(second).groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(False).alias("seen")
    )
    return answered(one, written(both, "groups"))


def kept_rows(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of repeated rows one.  Texts are shuffled once."""
    own, sha, id_, sha_ = fresh(docs, "own", "sha", "stay_id", "stay_sha")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    stay = exact_dedup(docs, index, batch).filter("kept").select(name.alias(id_), F.col("text_sha256").alias(sha_))
    rows = docs.withColumn(own, name).withColumn(sha, digest(text_or_empty()))
    out = rows.join(stay, (F.col(own) == F.col(id_)) & (F.col(sha) == F.col(sha_)), "left_semi")
    return out.dropDuplicates([own, sha]).select(*docs.columns)
