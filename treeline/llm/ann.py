"""Approximate nearest neighbours by inner product: score-aware quantisation, four-bit table scans, exact reranking.

Vectors are cut into subspaces of two dimensions, each with sixteen centroids.  What quantisation loses along the vector
itself changes inner products with its near queries most, so that part of the residual weighs ``eta`` times the rest, in
learning (by alternating assignment and weighted least squares, on a bounded sample) and in encoding (by coordinate
descent).  A query's inner products with all centroids, as bytes, make its tables; a scan adds table entries for two
codes at a time.  The best of each block of rows are scored exactly, on the original vectors in double precision, summed
in order of dimension.

Every row is indexed, and every query meets every row: queries and rows are dealt by hash into blocks, each block of
queries goes by shuffle to each block of rows, and one task holds the tables of one block of queries while it reads rows.
Nothing but the centroids passes through the driver.

Defined results:
- vectors that are null, zero, of another dimension than most, or that hold a null, a NaN or an infinity take no part,
  as query or candidate; nor do rows of null vec_id;
- rows of one vec_id are one vector (the least, should they differ); a query isn't its own neighbour;
- ties of score go to the smaller vec_id; with fewer than K candidates all are returned; an empty table gives an empty
  result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import hashed_unit, long_id, sliced, written

NEAREST, CENTRES = 20, 16
#: Standard deviations of a random cosine from which a query counts as near, for the weight of the parallel residual.
NEAR = 2.0
#: Vectors in the learning sample; rows scanned together; bytes of a block of queries; standard errors of a table sum
#: below the last place within which rows are scored exactly.
SAMPLE, BLOCK, QUERY_BYTES, ERRORS = 20_000, 8192, 4 << 20, 5.0
#: Rows of a block that queries are sent to: at most; at least, while there are fewer blocks than the last.
MOST_ROWS, LEAST_ROWS, BLOCKS = 1 << 20, 4096, 16
TOGETHER, PAIRS = 64, 1 << 15


class Quantiser:
    """Centroids [subspaces, 16, 2] learned with the anisotropic loss."""

    def __init__(self, sample: np.ndarray, steps: int = 8, seed: int = 3):
        random = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.parts = (self.dim + 3) // 4 * 2  # an even number of subspaces, so that two codes fill a byte
        near = min(0.9, NEAR / self.dim**0.5)
        self.eta = max(1.0, (self.dim - 1) * near**2 / (1 - near**2))
        x = self.cut(sample)
        pick = random.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self.centres = x[pick].transpose(1, 0, 2).copy() + random.normal(0, 1e-4, (self.parts, CENTRES, 2))
        for _ in range(steps):  # plain k-means first
            codes = self.nearest(x)
            self.centres = self.refit(x, codes, 1.0)
        for _ in range(steps):
            self.centres = self.refit(x, self.encode(sample), self.eta)
        codes = self.encode(sample)
        lost = sum(((x[:, m] - self.centres[m][codes[:, m]]) ** 2).sum(axis=1) for m in range(self.parts))
        self.error = float(np.sqrt(lost.mean() / self.dim))  # standard error of a product with a query of length 1

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(vectors), self.parts * 2))
        wide[:, : self.dim] = vectors
        return wide.reshape(len(vectors), self.parts, 2)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        codes = np.empty((len(x), self.parts), np.uint8)
        for m in range(self.parts):
            c = self.centres[m]
            codes[:, m] = ((c**2).sum(axis=1) - 2 * x[:, m] @ c.T).argmin(axis=1)
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray, eta: float) -> np.ndarray:
        """The centroids that minimise the loss for given codes, one subspace after the other."""
        out = self.centres.copy()
        unit = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        left = sum(((x[:, m] - out[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(self.parts))
        for m in range(self.parts):
            u, code = unit[:, m], codes[:, m]
            own = ((x[:, m] - out[m][code]) * u).sum(axis=1)
            rest = left - own
            right = x[:, m] + (eta - 1) * u * (rest + (x[:, m] * u).sum(axis=1))[:, None]
            for k in range(CENTRES):
                some = code == k
                if not some.any():
                    continue
                a = some.sum() * np.eye(2) + (eta - 1) * u[some].T @ u[some]
                out[m, k] = np.linalg.solve(a, right[some].sum(axis=0))
            left = rest + ((x[:, m] - out[m][code]) * u).sum(axis=1)
        return out

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that minimise |r|^2 + (eta - 1) (r . x/|x|)^2, r the residual, by coordinate descent."""
        x = self.cut(vectors)
        unit = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-30)
        codes = self.nearest(x)
        lost = [((x[:, m] - self.centres[m][codes[:, m]]) * unit[:, m]).sum(axis=1) for m in range(self.parts)]
        left = sum(lost)
        for _ in range(sweeps):
            for m in range(self.parts):
                c = self.centres[m]
                square = (c**2).sum(axis=1) - 2 * x[:, m] @ c.T
                along = (x[:, m] * unit[:, m]).sum(axis=1)[:, None] - unit[:, m] @ c.T
                rest = left - lost[m]
                codes[:, m] = (square + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(axis=1)
                lost[m] = along[np.arange(len(x)), codes[:, m]]
                left = rest + lost[m]
        return codes

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        codes = self.encode(vectors)
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and byte of a code 256 sums of two table entries, on a scale of bytes: [queries, bytes, 256];
        with the scale, and the product that a sum of 0 stands for."""
        product = np.einsum("qmd,mkd->qmk", self.cut(queries), self.centres)
        least = product.min(axis=2, keepdims=True)
        scale = np.maximum((product - least).max(axis=(1, 2), keepdims=True), 1e-30) / 255
        small = np.rint((product - least) / scale).astype(np.uint16)
        both = (small[:, 1::2, :, None] + small[:, 0::2, None, :]).reshape(len(queries), -1, 256)
        return both, scale[:, 0, 0], least.sum(axis=(1, 2))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added up in order."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Table sums of each query and row."""
    total = np.zeros((len(tables), len(packed)), np.int32)
    for j in range(packed.shape[1]):
        total += np.take(tables[:, j], packed[:, j], axis=1)
    return total


class Best:
    """The nearest so far of each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, quantiser: Quantiser, nearest: int):
        self.ids, self.queries, self.nearest, self.error = ids, queries, nearest, quantiser.error
        self.tables = [quantiser.tables(queries[i : i + TOGETHER]) for i in range(0, len(ids), TOGETHER)]
        self.found = np.full((len(ids), nearest), np.iinfo(np.int64).max)
        self.score = np.full((len(ids), nearest), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray) -> None:
        """Looks through a block of rows.  Equal vectors are scanned once and stand for their least ids, so that many
        copies of one vector don't crowd out others."""
        order = np.argsort(ids, kind="stable")
        ids, vectors, packed = ids[order], np.ascontiguousarray(vectors[order]), packed[order]
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        copy = np.empty(len(ids), np.int64)  # the how-manieth of its group, by id
        copy[order] = np.arange(len(ids)) - np.searchsorted(group[order], group[order])
        most = int(min(self.nearest + 1, copy.max() + 1))
        names = np.full((len(first), most), np.iinfo(np.int64).max)
        names[group[copy < most], copy[copy < most]] = ids[copy < most]
        vectors, packed, keep = vectors[first].astype(np.float64), packed[first], self.nearest + 1
        longest = np.sqrt((vectors**2).sum(axis=1).max())
        for n, (tables, scale, zero) in enumerate(self.tables):
            own = slice(n * TOGETHER, n * TOGETHER + len(tables))
            total = scan(tables, packed)
            few = min(2 * keep, len(packed))
            top = np.argpartition(total, len(packed) - few, axis=1)[:, -few:]
            score = np.sort(np.einsum("qcd,qd->qc", vectors[top], self.queries[own]), axis=1)[:, -min(keep, few)]
            if few < keep:
                score[:] = -np.inf
            length = np.sqrt((self.queries[own] ** 2).sum(axis=1))
            sure = np.maximum(score, self.score[own, -1]) - 1e-9 * length * longest  # nothing below it is among the nearest
            last = sure - ERRORS * self.error * length
            query, row = np.nonzero((total >= ((last - zero) / scale)[:, None]) | ~np.isfinite(last)[:, None])
            near, exact = [], []
            for i in range(0, len(query), PAIRS):
                part = slice(i, i + PAIRS)
                some = i + np.flatnonzero(~(np.einsum("pd,pd->p", vectors[row[part]], self.queries[own][query[part]]) < sure[query[part]]))
                near.append(some)
                exact.append(products(vectors[row[some]], self.queries[own][query[some]]))
            near, exact = np.concatenate(near or [np.zeros(0, int)]), np.concatenate(exact or [np.zeros(0)])
            query, row = query[near], row[near]
            query, found, exact = np.repeat(query, most), names[row].ravel(), np.repeat(exact, most)
            good = (found != self.ids[own][query]) & (found != np.iinfo(np.int64).max)
            old = np.repeat(np.arange(len(tables)), self.nearest)
            query = np.concatenate([old, query[good]])
            found = np.concatenate([self.found[own].ravel(), found[good]])
            exact = np.concatenate([self.score[own].ravel(), exact[good]])
            order = np.lexsort((found, -exact, query))
            query = query[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            order = order[rank < self.nearest]  # the old ones alone are enough to fill every query's places
            self.score[own] = exact[order].reshape(-1, self.nearest)
            self.found[own] = found[order].reshape(-1, self.nearest)

    def rows(self) -> pa.RecordBatch:
        good = np.isfinite(self.score)
        query = np.broadcast_to(self.ids[:, None], good.shape)[good]
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.found[good]), pa.array(self.score[good])], names=["query_id", "vec_id", "score"])


def usable(name: str = "embedding") -> Column:
    good = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(name, lambda x: x != 0) & (F.size(name) > 0), F.lit(False))


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def indexed(vectors: DataFrame) -> tuple[DataFrame, Quantiser | None]:
    """A table vec_id, vector (bytes of float32 or, if these lose anything, float64), codes, of all usable rows."""
    spark = vectors.sparkSession
    elements = vectors.schema["embedding"].dataType.elementType.typeName()
    own = F.col("embedding") if elements in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select(long_id(vectors, "vec_id").alias("vec_id"), own.alias("embedding")).filter(F.col("vec_id").isNotNull() & usable())
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows.select("vec_id"), None
    dim = dims["d"]
    rows = rows.filter(F.size("embedding") == dim)
    key = F.col("vec_id").cast("string")
    drawn = rows.filter(hashed_unit("ann", key) < min(1.0, SAMPLE / dims["count"])).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = np.array([r["embedding"] for r in drawn.orderBy("vec_id").limit(2 * SAMPLE).collect()], np.float64)
    if not len(sample):
        sample = np.array([rows.orderBy("vec_id").first()["embedding"]], np.float64)
    quantiser = Quantiser(sample)
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            if len(batch):
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes = shared.value.packed(x.astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["vec_id", "vector", "codes"],
                )

    one = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return written(one.mapInArrow(encode, "vec_id long, vector binary, codes binary"), "codes"), quantiser


def searched(vectors: DataFrame, every: int = 20, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    table, quantiser = indexed(vectors)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, wide, shared = quantiser.dim, quantiser.parts // 2, spark.sparkContext.broadcast(quantiser)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    asking = F.col("vec_id") % every == 0
    count, asked = table.agg(F.count(F.lit(1)), F.count(F.when(asking, 1))).first()
    query_blocks = max(1, -(-asked * dim * 8 // QUERY_BYTES))
    row_blocks = max(1, min(BLOCKS, -(-count // LEAST_ROWS)), -(-count // MOST_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    queries = table.filter(asking).select(dealt(query_blocks).alias("queries"), each(row_blocks).alias("rows"), F.lit(False).alias("row"), "vec_id", "vector", F.lit(b"").alias("codes"))
    rows = table.select(each(query_blocks).alias("queries"), dealt(row_blocks).alias("rows"), F.lit(True).alias("row"), "vec_id", "vector", "codes")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, asks, block = None, [], [], None

        def scanned() -> None:
            nonlocal best
            if held and asks:
                if best is None:
                    ids, vectors = (np.concatenate(x) for x in zip(*asks, strict=True))
                    best = Best(ids, vectors.astype(np.float64), shared.value, nearest)
                best.add(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()

        for batch in sliced(batches, 4096):
            places = np.stack([batch.column(c).to_numpy() for c in ("queries", "rows")], axis=1)
            row = batch.column("row").to_numpy(zero_copy_only=False).astype(bool)
            edge = np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(axis=1) | (row[1:] != row[:-1])))
            for i, j in zip(edge, np.append(edge[1:], len(row)), strict=True):
                if (own := tuple(places[i])) != block:
                    scanned()
                    if best:
                        yield best.rows()
                    best, asks, block = None, [], own
                some = batch.slice(i, j - i)
                ids, own_vectors = some.column("vec_id").to_numpy(), matrix(some.column("vector"), dim, kind)
                if not row[i]:
                    asks.append((ids, own_vectors))
                elif asks:
                    held.append((ids, own_vectors, matrix(some.column("codes"), wide, np.uint8)))
                    if sum(len(x) for x, _, _ in held) >= BLOCK:
                        scanned()
        scanned()
        if best:
            yield best.rows()

    met = queries.unionByName(rows).repartition("queries", "rows").sortWithinPartitions("queries", "rows", "row", "vec_id")
    found = met.mapInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
