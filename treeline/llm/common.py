"""What the operators share: scratch tables in the shared folder, input tables, column hygiene."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, as a character class body (space, \t, \n, \v, \f, \r).
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (spark.checkpoint.dir); where it is unset, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/treeline-{name}-{uuid.uuid4().hex[:12]}"


_scratch: list[str] = []


def cleared(spark: SparkSession) -> int:
    """Deletes the scratch tables that this process has written, once no result that reads them is needed any more."""
    jvm, count = spark.sparkContext._jvm, len(_scratch)
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, any executor may be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing reads it any more."""
    jvm, paths = spark.sparkContext._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        if "/treeline-" not in p:
            raise ValueError(f"'{p}' is no scratch table")
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _scratch[:] = [p for p in _scratch if p.rsplit("/", 1)[-1] not in {q.rsplit("/", 1)[-1] for q in paths}]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def modest_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in an Arrow batch, for sessions of small executors: what the JVM and Python hold of one text column.

    For those that own the session, such as the registered queries; the operators leave its settings alone, and bound by
    ``sliced`` what they make of a batch, whatever its size.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch in slices of at most ``rows`` rows and about ``size`` bytes: bounds what Python makes of one."""
    for batch in batches:
        step = max(1, min(rows, int(len(batch) * size / max(batch.nbytes, 1))))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Returns to the system the memory that this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``, after which its worker gives memory back: workers live on, also idle ones, and would
    keep the most that any task before needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it new to ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def hashed_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key: 52 bits, the same in every run and every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    return F.col(name).cast("long") if not isinstance(df.schema[name].dataType, T.LongType) else F.col(name)


def pieces(texts: list, most: int) -> list[tuple[int, int]]:
    """Index ranges over ``texts``, each of about ``most`` characters or a single text: bounds numpy temporaries."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        out.append((start, len(texts)))
    return out


#: Groups that hold at least this share of all rows number at most 1/share: these few may be broadcast.
HOT_SHARE = 1 / 500


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to the one row of ``groups`` for their ``key``; column ``size`` of it counts the key's rows.

    The rows of hot groups, at most 1 / HOT_SHARE groups, meet a broadcast; no other key holds more than HOT_SHARE of all
    rows, so the sort-merge join of the others has no hot task.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(2, int((total or 0) * HOT_SHARE) + 1)
    if (most or 0) < least:
        return rows.join(groups, key)
    hot = groups.filter(F.col(size) >= least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) < least), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
