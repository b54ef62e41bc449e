"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct shingles of WIDTH words.  Documents of equal sets are one node from
the start.  All tokens are ordered by frequency (a counting sketch of bounded size over all documents; it orders, it
decides nothing), rare ones first.  Of a set of n tokens the first n - o + EXTRA make an extended prefix, o being the
least overlap with a partner: with any partner T n, with one that is not smaller 2 T n / (1 + T).  Two sets that reach
the similarity T share at least min(EXTRA, the needed overlap) tokens of the smaller set's inner prefix (by the second
bound) and the larger one's outer prefix (by the first).  Sets made from one template, which share their frequent tokens
but are not similar enough, mostly have no frequent token left in their inner prefixes and never meet.

- Rare tokens are indexed one by one.  By the sketch their lists are short, so their pairs are counted; the rare tokens
  that a pair shares, and the frequent ones that its prefixes have room for, must reach min(EXTRA, needed overlap).  What
  is left is verified.
- Of frequent tokens, combinations of two are indexed: two sets that share no rare token of their prefixes share at
  least two frequent ones (or all they need).  Where a prefix holds more than LIGHT frequent tokens, combinations
  would grow with its square; such a set is indexed by each frequent token instead, and met there by all others.
  A combination counts where it lies in some set's inner prefix.
  Sets that meet (directly or along others) form a cluster, and each cluster is verified by an inverted index over
  whole sets, in blocks: a big group of near copies costs no list of its pairs, and lands in no single task.

Verified links are exact over whole sets; components come from links alone.

Defined results:
- null and empty texts, and texts without words: no shingles, component_id is the document's own id;
- a text of fewer than WIDTH words has one shingle, the whole;
- repeated rows are documents each; ties play no part; an empty table gives an empty result;
- the component's id is its least doc_id; null ids are counted last; further columns are ignored;
- hashes have 64 bits: sets are told apart by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.arrays import byte_column, mix, spans_of_bytes
from treeline.llm.common import dropped, fresh, joined_by_group, long_id, sliced, text_or_empty, tidy, written
from treeline.llm.components import components
from treeline.llm.shingles import shingle_sets

WIDTH, PERCENT = 5, 75
#: Extra prefix tokens; the most frequent tokens in a prefix that are still combined.
EXTRA, LIGHT = 4, 24
#: The sketch has a counter for each so many words, within these bounds (as powers of two).
WORDS_EACH, LEAST_BITS, MOST_BITS = 8, 18, 25
#: Records of an index partition, and those of it whose pairs are made together; counters of a sketch block; pairs that
#: are made at a time.
RECORDS, LISTED, BLOCK, PAIRS = 1_000_000, 250_000, 1 << 12, 1 << 21
#: Sets of a cluster that are verified together: at most, and tokens of them at most; at least, while a cluster has fewer
#: blocks than SPREAD.
MOST_TOGETHER, TOKENS_TOGETHER, LEAST_TOGETHER, SPREAD = 1024, 1 << 21, 64, 32
#: Sets of a cluster that all its blocks hold.
HUBS = 16
STEP, FLUSH = 1 << 19, 600_000

RECORD = np.dtype([("key", "<u8"), ("sig", "<u8"), ("n", "<u4"), ("m", "<u2")])
#: As sent for rare tokens: the part and 41 bits of the key tell tokens apart (those that clash make pairs that are then
#: verified in vain); the other 7 bits of ``more`` are m.
SENT = np.dtype([("key", "<u4"), ("more", "<u2"), ("sig", "<u8"), ("size", "<u4")])
RARE, FREQUENT, DOCUMENT = 0, 1, 2
#: m of a rare token: whether it is in the inner prefix, and the frequent tokens in the inner and in the outer prefix, up
#: to 7 each.  m of a frequent key: this where it is in an inner prefix, plus 3 for a combination, for a single key 2 of
#: a set that meets all others there, 1 of one that meets only those.
INNER = 4


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n tokens with any set that it links to."""
    return -(-PERCENT * n // 100)


def needed_alike(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n tokens with a set of as many tokens or more that it links to."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def each_set(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, tokens and bounds of the sets of some rows at a time; a text that is longer than STEP comes alone."""
    data, offsets = byte_column(batch.column("_text"))
    done = 0
    for first, last, begin, _ in spans_of_bytes(offsets, STEP):
        if first < done:
            continue  # a long text is whole already
        done = last
        yield first, *shingle_sets(data[begin : offsets[last]], offsets[first : last + 1] - begin, WIDTH)


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (0 for an empty one)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mix(total[at[1:]] - total[at[:-1]] + n * np.uint64(0xD6E8FEB86659FD93)), 0).astype(np.uint64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, twelve to each doubling."""
    return np.minimum(255, np.rint(12 * np.log2(1.0 + counts))).astype(np.uint8)


class Frequencies:
    """The sketch: a level for each counter, and the level up to which tokens are rare."""

    def __init__(self, level: np.ndarray):
        self.level = level
        self.shift = np.uint64(64 - int(len(level)).bit_length() + 1)
        mean = float(np.bincount(level, minlength=256) @ (np.exp2(np.arange(256) / 12.0) - 1)) / max(len(level), 1)
        #: Counters that unrelated tokens alone fill hardly exceed this.
        self.rare = int(levels(np.array([mean + 4 * mean**0.5 + 4]))[0])

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.level[(tokens >> self.shift).astype(np.int64)]


def counted(docs: DataFrame) -> Frequencies:
    """In how many documents each token occurs, about: counters summed over all documents; tokens of one counter go together."""
    words = (docs.agg(F.sum(F.length("_text"))).first()[0] or 0) / 6
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(words / WORDS_EACH, 1))))))
    width, block = 1 << bits, min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = np.zeros(width, np.uint16), 0

        def out() -> pa.RecordBatch:
            raw = np.minimum(own, 255).astype(np.uint8).reshape(-1, block)
            some = np.flatnonzero(raw.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pa.compress(raw[i], "zstd", asbytes=True) for i in some], pa.binary())], names=["block", "counts"])

        for batch in sliced(batches):
            for _, tokens, _ in each_set(batch):
                np.add.at(own, (tokens >> np.uint64(64 - bits)).astype(np.int64), np.uint16(1))
            rows += len(batch)
            if rows > 40_000:  # before a counter can overflow
                yield out()
                own[:], rows = 0, 0
        if rows:
            yield out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if i not in sums:
                    sums[i] = np.zeros(block, np.uint32)
                sums[i] += np.frombuffer(pa.decompress(raw, block, "zstd"), np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([levels(x).tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"]
        )

    kind = "block int, counts binary"
    level = np.zeros(width, np.uint8)
    for r in docs.select("_text").mapInArrow(tidy(count), kind).repartition("block").mapInArrow(tidy(total), kind).collect():
        level[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.uint8)
    return Frequencies(level)


def prefixes(tokens: np.ndarray, at: np.ndarray, of: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, token, whether frequent and whether in the inner prefix, of each token in the extended prefixes."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    level = of.of(tokens)
    level = np.where(level <= of.rare, 0, level)
    order = np.lexsort((tokens, level, row))
    length, inner = (np.minimum(n, n - o + EXTRA) for o in (needed(n), needed_alike(n)))
    place = np.arange(len(tokens)) - np.repeat(at[:-1], n)
    some = place < np.repeat(length, n)
    pick = order[some]
    return row[pick], tokens[pick], level[pick] > 0, (place < np.repeat(inner, n))[some]


def combined(row: np.ndarray, token: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each combination of two tokens of a row (rows ascending): row, key, whether both are in the inner prefix."""
    first = np.searchsorted(row, row)
    place = np.arange(len(row)) - first
    left = np.repeat(np.arange(len(row)), place)
    right = np.arange(len(left)) - np.repeat(np.cumsum(place) - place, place) + first[left]
    low, high = np.minimum(token[left], token[right]), np.maximum(token[left], token[right])
    return row[left], mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high)), inner[left] & inner[right]


def index_records(tokens: np.ndarray, at: np.ndarray, sig: np.ndarray, of: Frequencies) -> list[tuple[int, np.ndarray]]:
    """(kind, records) of the sets: rare tokens one by one; frequent ones combined, and singly with m for the heavy."""
    n = np.diff(at)
    row, token, frequent, inner = prefixes(tokens, at, of)
    m, m_inner = (np.bincount(row, x, minlength=len(n)).astype(np.int64) for x in (frequent, frequent & inner))

    def made(rows: np.ndarray, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), RECORD)
        out["key"], out["sig"], out["n"], out["m"] = keys, sig[rows], n[rows], more
        return out

    few = np.minimum(m_inner, 7) << 1 | np.minimum(m, 7) << 4
    rare = made(row[~frequent], token[~frequent], few[row[~frequent]] | inner[~frequent])
    # a set that shares no rare token with a partner needs so many frequent ones
    least = np.minimum(EXTRA, needed(n))
    some = frequent & (m >= least)[row]
    row, token, inner = row[some], token[some], (inner & (m_inner >= least)[row])[some]
    single = made(row, token, np.where((m[row] > LIGHT) | (least[row] < 2), 2, 1) + INNER * inner)
    light = m[row] <= LIGHT
    pair_row, key, both = combined(row[light], token[light], inner[light])
    return [(RARE, rare), (FREQUENT, np.concatenate([single, made(pair_row, key, 3 + INNER * both)]))]


def indexed(docs: DataFrame, of: Frequencies, size: float) -> DataFrame:
    """A table of rare pairs (RARE: a, b, their n, in flag the frequent tokens they have room for, count), frequent keys
    (FREQUENT: a the key, b the set, na its size, flag) and documents (DOCUMENT: a doc_id, b the set, na its size, flag 1 for a null id)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(of)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / RECORDS) + 1)
    fine = 1 << int(np.ceil(np.log2(16 * parts)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {RARE: [], FREQUENT: [], DOCUMENT: []}
        seen: set[int] = set()
        count = 0

        def flush() -> pa.RecordBatch:
            part, kinds, blobs = [], [], []
            for kind, made in held.items():
                rows = np.concatenate([np.zeros(0, RECORD), *made])
                if not len(rows):
                    continue
                at = (mix(rows["key" if kind == RARE else "sig"]) & np.uint64(fine - 1)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                rows, at = rows[order], at[order]
                if kind == RARE:
                    some = np.empty(len(rows), SENT)
                    some["key"], some["more"], some["sig"] = rows["key"] & np.uint64(0xFFFFFFFF), rows["key"] >> np.uint64(55) << np.uint64(7) | rows["m"], rows["sig"]
                    some["size"] = rows["n"]
                    rows = some
                edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                for i, j in zip(edge, np.append(edge[1:], len(at)), strict=True):
                    part.append(at[i])
                    kinds.append(kind)
                    blobs.append(rows[i:j].tobytes())
            for some in held.values():
                some.clear()
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

        for batch in sliced(batches):
            ids = batch.column("doc_id")
            for first, tokens, at in each_set(batch):
                sig, n = signatures(tokens, at), np.diff(at)
                own = ids.slice(first, len(n))
                doc = np.empty(len(n), RECORD)
                doc["key"], doc["sig"], doc["n"] = own.fill_null(0).to_numpy().astype(np.int64).view(np.uint64), sig, n
                doc["m"] = own.is_null().to_numpy(zero_copy_only=False)
                held[DOCUMENT].append(doc)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):
                    if (s := int(sig[i])) not in seen:
                        seen.add(s)
                        fresh[i] = True
                keep = np.repeat(fresh, n)
                few = np.concatenate([[0], np.cumsum(n[fresh])]).astype(np.int64)
                for kind, rows in index_records(tokens[keep], few, sig[fresh], shared.value):
                    held[kind].append(rows)
                    count += len(rows)
            if count > FLUSH:
                yield flush()
                count = 0
        if any(held.values()):
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == RARE:
                    rare.setdefault(part, []).append(blob.as_py())  # a copy: it outlives the batch
                else:
                    rows = np.frombuffer(blob.as_buffer(), RECORD)
                    yield table_of(kind, rows["key"], rows["sig"], rows["n"], rows["n"], rows["m"], np.ones(len(rows)))
        yield from listed_pairs(rare)

    rows = docs.select("doc_id", "_text").mapInArrow(tidy(emit), "part int, kind int, blob binary")
    return written(rows.repartition(parts, "part").mapInArrow(tidy(meet), "kind int, a long, b long, na int, nb int, flag int, c int"), "index")


def table_of(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, flag: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), a.astype(np.uint64).view(np.int64), b.astype(np.uint64).view(np.int64)]
    columns += [x.astype(np.int32) for x in (na, nb, flag, c)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "a", "b", "na", "nb", "flag", "c"])


def received(part: int, blob: bytes) -> np.ndarray:
    """The records of rare tokens as they were before they were sent."""
    sent = np.frombuffer(blob, SENT)
    rows = np.empty(len(sent), RECORD)
    rows["key"] = (np.uint64(part) << np.uint64(41)) | (sent["more"] >> 7).astype(np.uint64) << np.uint64(32) | sent["key"]
    rows["sig"], rows["n"], rows["m"] = sent["sig"], sent["size"], sent["more"] & 127
    return rows


def listed_pairs(rare: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """``rare_pairs`` of what was sent to each part, which holds its tokens' lists whole: some parts at a time, LISTED records
    or one part, since working memory is several times the records."""
    some: list[np.ndarray] = []
    while rare:
        part, blobs = rare.popitem()
        rows = np.concatenate([received(part, b) for b in blobs])
        if some and sum(map(len, some)) + len(rows) > LISTED:
            yield from rare_pairs(np.concatenate(some))
            some = []
        some.append(rows)
    if some:
        yield from rare_pairs(np.concatenate(some))


def rare_pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of sets of fitting sizes that meet at a rare token in the smaller one's inner prefix, with how often they
    do in these lists, and how many frequent tokens their prefixes have room for."""
    order = np.lexsort((rows["sig"], rows["n"], rows["key"]))  # of two, the smaller set comes first
    key, sig = rows["key"][order], rows["sig"][order]
    new = np.append(True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))
    order, key = order[new], key[new]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    n, inner = rows["n"].astype(np.int64), rows["m"] & 1
    left, right = [], []
    for k in np.unique(size[size > 1]):
        first, second = np.triu_indices(k, 1)
        starts, step = edge[size == k], max(1, PAIRS // len(first))
        for at in range(0, len(starts), step):
            members = order[starts[at : at + step][:, None] + np.arange(k)]
            x, y = members[:, first].ravel(), members[:, second].ravel()
            fit = (100 * n[x] >= PERCENT * n[y]) & (inner[x] > 0)
            left.append(x[fit])
            right.append(y[fit])
    if not left:
        return
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((rows["sig"][b], rows["sig"][a]))
    a, b = a[order], b[order]
    if not len(a):
        return
    x, y = rows[a], rows[b]
    edge = np.flatnonzero(np.append(True, (x["sig"][1:] != x["sig"][:-1]) | (y["sig"][1:] != y["sig"][:-1])))
    count = np.diff(np.append(edge, len(a)))
    x, y = x[edge], y[edge]
    room = np.minimum(x["m"] >> 1 & 7, y["m"] >> 4 & 7)
    for i in range(0, len(x), 50_000):
        s = slice(i, i + 50_000)
        yield table_of(RARE, x["sig"][s], y["sig"][s], x["n"][s], y["n"][s], room[s], count[s])


def bloom(sigs: DataFrame) -> tuple[np.ndarray, int]:
    """A packed bitmap of the signatures' hashes, and how many bits address it: so many bits that few others pass, 2**28 at most."""
    count = sigs.count()
    bits = int(min(28, max(12, np.ceil(np.log2(64 * max(count, 1))))))
    wide = 1 << min(bits, 15)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = mix(batch.column("sig").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            at = np.unique(at.astype(np.int64))
            for i in np.unique(at // wide):
                raw = np.zeros(wide, bool)
                raw[at[at // wide == i] - i * wide] = True
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(raw).tobytes()], pa.binary())], names=["block", "bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint8)
                sums[i] = sums[i] | x if i in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "bits"])

    kind, out = "block int, bits binary", np.zeros(1 << bits >> 3, np.uint8)
    for r in sigs.mapInArrow(tidy(mark), kind).repartition("block").mapInArrow(tidy(both), kind).collect():
        out[r["block"] * wide // 8 : (r["block"] + 1) * wide // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def sets_of(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """sig, tokens (bytes of the sorted hashes) of the signatures asked for, from the texts again."""
    marks, bits = bloom(sigs)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, set()
        for batch in sliced(batches):
            for _, tokens, at in each_set(batch):
                sig = signatures(tokens, at)
                place = (mix(sig) >> np.uint64(64 - bits)).astype(np.int64)
                wanted = (at[1:] > at[:-1]) & ((own[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0)
                pick = [i for i in np.flatnonzero(wanted) if not (int(sig[i]) in seen or seen.add(int(sig[i])))]
                if pick:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[pick].view(np.int64)), pa.array([tokens[at[i] : at[i + 1]].tobytes() for i in pick], pa.binary())],
                        names=["sig", "tokens"],
                    )

    found = docs.select("_text").mapInArrow(tidy(emit), "sig long, tokens binary").join(sigs, "sig", "left_semi")
    return written(found.groupBy("sig").agg(F.first("tokens").alias("tokens")), "sets")


def linked(n: np.ndarray, k: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + k - overlap)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(bool(linked(len(p), len(q), both)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


class Forest:
    """Union-find over places."""

    def __init__(self, count: int):
        self.up = np.arange(count)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up


def cluster_links(sets: list[np.ndarray], ask: np.ndarray, comps: np.ndarray, starts: int = 8) -> list[tuple[int, int]]:
    """Links that connect whatever the links between asked sets and all others connect, beyond what ``comps`` says is
    connected already.

    An inverted index gives the overlaps of one set with all others at once.  Where all are asked, the members of the
    greatest component need not be after some first sets: what they link to outside is asked itself.
    """
    n = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    forest, out = Forest(len(sets)), []
    _, first, same = np.unique(comps, return_index=True, return_inverse=True)
    forest.up = first[same]

    def look(i: int) -> None:
        low, high = np.searchsorted(tokens, sets[i], side="left"), np.searchsorted(tokens, sets[i], side="right")
        size = high - low
        place = np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())
        overlap = np.bincount(owner[place], minlength=len(sets))
        for j in np.flatnonzero(linked(n[i], n, overlap)):
            if (p := forest.root(i)) != (q := forest.root(int(j))):
                forest.up[max(p, q)] = min(p, q)
                out.append((i, int(j)))

    early = ask[:: max(1, len(ask) // starts)][:starts]
    for i in early:
        look(int(i))
    roots = forest.roots()
    names, counts = np.unique(roots, return_counts=True)
    most = names[counts.argmax()]
    whole = len(ask) == len(sets)
    for i in np.setdiff1d(ask, early):
        if not (whole and roots[i] == most):
            look(int(i))
    return out


def block_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) among the rows (sig, tokens, comp, asks) that share all ``keys``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def out() -> pa.RecordBatch:
            sig = list(held)
            links: list[tuple[int, int]] = []
            if len(sig) > 1:
                asks = np.flatnonzero([held[s][2] for s in sig])
                links = cluster_links([held[s][0] for s in sig], asks, np.array([held[s][1] for s in sig], np.int64))
            a, b = np.array([sig[i] for i, _ in links], np.int64), np.array([sig[j] for _, j in links], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in sliced(batches):
            columns = [batch.column(c).to_pylist() for c in (*keys, "sig", "tokens", "comp", "asks")]
            for *own, s, raw, comp, ask in zip(*columns, strict=True):
                if own != key:
                    if held:
                        yield out()
                    key, held = own, {}
                held[s] = (np.frombuffer(raw, np.uint64), comp, ask or (s in held and held[s][2]))
        if held:
            yield out()

    rows = rows.select(*keys, "sig", "tokens", "comp", "asks")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sig").mapInArrow(tidy(check), "a long, b long")


def blocks_of(count: Column) -> Column:
    """Into how many blocks so many sets are dealt."""
    return F.greatest(F.ceil(count / F.lit(float(MOST_TOGETHER))), F.least(F.lit(SPREAD), F.ceil(count / F.lit(float(LEAST_TOGETHER))))).cast("int")


def clustered(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect the sets of each cluster as all their links would; ``members``: sig, root, n, inner (whether the
    set may be the smaller one of a link that frequent tokens alone find).

    A cluster is dealt by hash into blocks (``blocks_of``, or more where TOKENS_TOGETHER asks for it), and each block is
    searched by itself, with some hubs of the cluster that all its blocks hold: they tie together what belongs to one large
    group of near copies.  Of a cluster in several blocks, the sets outside its greatest component (mostly few) then go
    around its blocks, in chunks dealt likewise: the inner ones meet all sets, the others the inner sets.
    """
    blocks = F.greatest(blocks_of(F.count(F.lit(1))), F.ceil(F.sum("n") / F.lit(float(TOKENS_TOGETHER))).cast("int"))
    size = members.groupBy("root").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("rows"))
    rows = joined_by_group(members, size, "root", "rows").drop("rows")
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")), "blocks")
    several = rows.filter("blocks > 1")
    place = Window.partitionBy("root").orderBy("sig")
    hubs = several.withColumn("hub", F.row_number().over(place)).filter(F.col("hub") <= HUBS)
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("root", "block", "sig").unionByName(hubs.select("root", "block", "sig")).distinct()
    asked = dealt.join(sets, "sig").withColumns({"comp": F.col("sig"), "asks": F.lit(True)})
    within = written(block_links(asked, ["root", "block"]), "links")
    if several.isEmpty():
        return within
    found = components(within).withColumnRenamed("root", "comp").withColumnRenamed("node", "sig")
    several = written(several.join(found, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "several")
    greatest = several.groupBy("root", "comp").count().groupBy("root").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"))
    count = several.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
    outside = joined_by_group(several, greatest.join(count, "root"), "root", "rows").filter("comp <> most").drop("most", "rows")
    outside = written(outside, "outside")
    chunks = outside.groupBy("root").agg(blocks_of(F.count(F.lit(1))).alias("chunks")).join(count, "root")
    each = lambda df: joined_by_group(df, chunks, "root", "rows").drop("rows")
    asking = each(outside).select(
        "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("inner").alias("all"),
        F.pmod(F.xxhash64("sig", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), "sig", "comp", F.lit(True).alias("asks"),
    )
    sides = F.explode(F.when(F.col("inner"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    present = each(several).withColumn("all", sides).select(
        "root", "block", "all", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sig", "comp", F.lit(False).alias("asks")
    )
    met = asking.unionByName(present.join(asking.select("root", "all", "chunk").distinct(), ["root", "all", "chunk"], "left_semi"))
    return within.unionByName(block_links(met.join(sets, "sig"), ["root", "block", "all", "chunk"]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    docs = docs.select(long_id(docs).alias("doc_id"), text_or_empty().alias("_text"))
    of = counted(docs)
    size = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    table = indexed(docs, of, size / 6 * (100 - PERCENT) / 100)
    own = table.filter(F.col("kind") == DOCUMENT).select(
        F.when(F.col("flag") == 0, F.col("a")).alias("doc_id"), F.col("b").alias("sig"), F.col("na").alias("n_shingles")
    )
    # rare tokens: pairs that meet often enough
    met = table.filter(F.col("kind") == RARE).groupBy("a", "b").agg(
        F.sum("c").alias("c"), F.max("flag").alias("flag"), F.max("na").alias("na"), F.max("nb").alias("nb")
    )
    least = F.least(F.lit(EXTRA), F.ceil(F.greatest("na", "nb") * F.lit(PERCENT) / F.lit(100)))
    pairs = written(met.filter(F.col("c") + F.col("flag") >= least).select("a", "b"), "pairs")
    # frequent tokens: sets that meet at a combination, or at a token of a heavy set
    keys = table.filter(F.col("kind") == FREQUENT).select(F.col("a").alias("key"), F.col("b").alias("sig"), F.col("na").alias("n"), "flag").distinct()
    inner = F.col("flag") >= INNER
    busy = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("flag") % INNER).alias("top"), F.max(inner).alias("inner"))
    busy = busy.filter("k > 1 and top > 1 and inner").select("key")
    edges = keys.join(busy, "key").select(F.col("key").alias("a"), F.col("sig").alias("b"))
    groups = components(edges)
    known = keys.groupBy("sig").agg(F.max("n").alias("n"), F.max(inner).alias("inner"))
    nodes = groups.select(F.col("node").alias("sig"), "root").unionByName(groups.select(F.col("root").alias("sig"), "root").distinct())
    members = written(nodes.join(known, "sig"), "members")
    wanted = written(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(members.select("sig")).distinct(), "wanted")
    if wanted.isEmpty():
        links = pairs
    else:
        sets = sets_of(docs, wanted)
        links = written(verified(pairs, sets).unionByName(clustered(members, sets)), "links")
        for done in (sets, pairs, members, wanted):
            dropped(docs.sparkSession, done)
    roots = components(links)
    names = own.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    names = written(names, "names")
    rooted = names.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = written(rooted, "rooted")
    least_ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = written(rooted.join(least_ids, "root").select("sig", "copies", "component_id"), "rooted")
    with_set = joined_by_group(own.filter("n_shingles > 0"), rooted, "sig", "copies")
    without = own.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id"]
    return with_set.select(*columns).unionByName(without.select(*columns))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the least id (rows of null id stay); all columns as they are."""
    (keep,) = fresh(docs, "keep")
    stay = near_duplicates(docs).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(keep)).distinct()
    out = docs.filter("doc_id is not null").join(stay, F.col("doc_id") == F.col(keep), "left_semi")
    return out.unionByName(docs.filter("doc_id is null"))
