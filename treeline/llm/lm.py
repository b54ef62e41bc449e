"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

A token's class is a group of words of like neighbours and, in it, a band of words of like frequency; the last band
holds all rare words of the group.  The token's probability is that of its group after the words before it, times that
of its band in the group, times that of the word in the band; each of the three is a softmax whose logits are sums of
weights of hashed features: the last word, the two skips before it, and the last two words together (for bands and
members, each combined with the class).  A rare word stands in features as its group, and within its band it has the
share of its exact count, plus one.

Groups come from word endings (the last three bytes): endings are clustered by how often which endings stand beside
them, counted over all training documents.  The weights start at zero, where the model is the unigram one, and are
trained by distributed gradient updates: in each round every task sums, over its part of the round's slice of the
training documents, how often the model expects each class after each feature, and how often it came; the weights move
by the difference, scaled by the expectation.  The slices of all rounds together hold every training document once.
Expectations are summed as integers, so the model doesn't depend on how the table is partitioned.

Counts are exact and over all training documents.  Frequent words (by a sample; which these are changes no result) are
counted in place; all others go by word through one shuffle, where each is counted and its count handed back to the
documents that hold it.  Each partition of words hands its most frequent ones to the driver too, so that the words of
the bands are the most frequent of all by exact counts, in the sample or not.  Weight rows and words in bands grow with
the training tokens (``sizes``).

Defined results:
- null text is empty: the end is its only token; an empty table gives an empty result;
- without training documents the model is the base model;
- rows of equal doc_id and text count each, and get the same scores; ties of frequency go by hash;
- long texts are scored whole, in pieces cut between words; further columns are ignored;
- words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.arrays import KeyTable, byte_column, mix
from treeline.llm.common import dropped, fold, hashed_unit, long_id, sliced, text_or_empty, written
from treeline.llm.shingles import _SPACE, word_bounds, word_endings, word_hashes

#: Frequent words counted in place; groups of words, bands of a group (the last is that of its rare words).
HEAD, GROUPS, BANDS = 1 << 16, 16, 16
#: Buckets of word endings, and of those beside them; axes that endings are clustered on.
ENDINGS, BESIDE, AXES = 1 << 12, 1 << 7, 12
#: Documents in the sample that names the frequent words.
SAMPLE_DOCS = 4_000
#: Rounds of training, each over its own slice of the training documents; length of a step, and what expectations are
#: smoothed by; a probability of 1 as an integer.
ROUNDS, RATE, SMOOTH, ONE = 4, 0.4, 3.0, 1 << 14
SIGN = np.uint64(1 << 63)
END = np.uint64(0xEB44ACCAB455D165)
START = 1 << 30
STEP, FLUSH, RECORDS = 2 << 20, 1_000_000, 2_000_000
#: Tokens whose logits are held at once, and whose expectations are summed at once.
CHUNK, TOGETHER = 1 << 14, 1 << 16
RECORD = np.dtype([("word", "<u8"), ("doc", "<u8"), ("n", "<u4"), ("ending", "<u2"), ("train", "<u1")])
#: What a partition of words hands back to a document; frequent words of it; counters that travel together.
BACK = np.dtype([("doc", "<u8"), ("tail", "<f8"), ("known", "<u4")])
PAIR = np.dtype([("word", "<u8"), ("n", "<i8"), ("ending", "<i8")])
BLOCK = 1 << 14
COUNTS, SIZES, BACKS, BEST = 0, 1, 2, 3
ODD = np.uint64(0x9E3779B97F4A7C15)


def sizes(tokens: int) -> tuple[int, int]:
    """Weight rows of each table of features, and words in a band, for a number of training tokens: the rows grow with
    its square root, the words with its fourth root from 2**27 on; so a model for a thousand times the text is some
    thirty times as large, and a token costs a few times as much."""
    rows = 1 << min(20, max(14, math.ceil(math.log2(4 * math.sqrt(tokens + 1)))))
    return rows, 32 << max(0, (int(tokens).bit_length() - 27) // 4)


def word_pieces(data: np.ndarray, offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """First row, row after the last, word hashes, buckets of endings, bounds, and whether the rows end; long rows are
    cut before a space."""

    def words(begin: int, end: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = word_bounds(data[begin:end], at)
        hashes, first = word_hashes(data[begin:end], at, bounds)
        return hashes, word_endings(data[begin:end], bounds, ENDINGS), first

    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        if last > row:
            begin = offsets[row]
            yield row, last, *words(begin, offsets[last], offsets[row : last + 1] - begin), True
            row = last
            continue
        at, over = int(offsets[row]), int(offsets[row + 1])
        while at < over:
            end = min(at + most, over)
            while end < over:
                space = np.flatnonzero(_SPACE[data[end : min(end + 4096, over)]])
                end = end + int(space[0]) if len(space) else min(end + 4096, over)
                if len(space):
                    break
            yield row, row + 1, *words(at, end, np.array([0, end - at])), end == over
            at = end
        row += 1


class Stream:
    """Tokens, as symbols, with the three before each, of rows in order; keeps the last ones of a row that is cut."""

    def __init__(self, end: int):
        self.end, self.lead = end, np.zeros(0, np.int64)

    def tokens(self, symbols: np.ndarray, first: np.ndarray, over: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Row, token, and the tokens one, two and three before it."""
        lead, rows, count = self.lead, len(first) - 1, np.diff(first)
        if over:
            last = np.cumsum(count + 1) - 1  # the places of the ends
            row = np.repeat(np.arange(rows), count + 1)
            token = np.empty(len(row), np.int64)
            inner = np.ones(len(row), bool)
            inner[last] = False
            token[inner], token[last] = symbols, self.end
            begin = np.concatenate([[0], last[:-1] + 1])
            self.lead = np.zeros(0, np.int64)
        else:
            row, token, begin = np.zeros(len(symbols), np.int64), symbols.astype(np.int64), np.zeros(1, np.int64)
            self.lead = np.append(lead, token)[-3:]
        known = len(lead)
        line = np.concatenate([np.full(3 - known, START), lead, token])
        before = []
        for k in (1, 2, 3):
            back = line[3 - k : len(line) - k].copy()
            for j in range(k):  # rows after the first have nothing before them
                at = begin[1:] + j
                at = at[at < len(token)]
                back[at[row[at] == np.arange(1, rows)[: len(at)]]] = START
            before.append(back)
        return row, token, before


class Head:
    """The frequent words; their endings, and their exact counts once known."""

    def __init__(self, words: np.ndarray, endings: np.ndarray):
        keys, first = np.unique(np.append(words, END), return_index=True)
        self.table = KeyTable(keys)
        self.endings = np.append(endings, 0)[first].astype(np.int64)
        self.counts = np.zeros(len(keys), np.int64)
        #: Words that were not counted in place: documents have their share of these by the shuffle.
        self.tailed = np.zeros(len(keys), bool)

    def joined(self, best: np.ndarray) -> Head:
        """This head with the PAIRs of words that were counted by the shuffle."""
        out = Head(np.append(self.table.keys, best["word"]), np.append(self.endings, best["ending"]))
        out.counts[np.searchsorted(out.table.keys, self.table.keys)] = self.counts
        place = np.searchsorted(out.table.keys, best["word"])
        out.counts[place], out.tailed[place] = best["n"], True
        return out


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(long_id(docs).alias("doc_id"), text_or_empty().alias("_text")).select(
        "doc_id", "_text", (fold(7) == 2).alias("held_out"), F.xxhash64("doc_id", "_text").alias("_doc")
    )


def head_words(docs: DataFrame) -> Head:
    """The most frequent words of a hash-drawn, bounded sample of training documents."""
    train = docs.filter(~F.col("held_out"))
    total = train.count()
    few = train.filter(hashed_unit("head", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < min(1.0, SAMPLE_DOCS / max(total, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for _, _, words, endings, _, _ in word_pieces(*byte_column(batch.column("_text"))):
                word, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(endings[first]), pa.array(n.astype(np.int64))], names=["word", "ending", "n"]
                )

    counts = few.select("_text").mapInArrow(count, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    top = counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(HEAD).collect()
    return Head(np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["ending"] for r in top], np.int64))


class Counted:
    """What one pass over all documents and one shuffle of words gather.

    ``sums``: a table doc, tail (sum of log10(c + 1) over its words outside the head), tail_known; ``tokens`` and
    ``distinct`` of the training documents; ``rare``: for each ending the count, and the number, of training words
    outside the head; ``best``: the most frequent of these; ``beside``: for each ending (and, last, the end) how often
    which endings stand before and after it.
    """

    def __init__(self, sums: DataFrame, head: Head, rare: np.ndarray, best: np.ndarray, beside: np.ndarray, table: DataFrame):
        self.sums, self.rare, self.best, self.beside, self.table = sums, rare, best, beside, table
        self.tokens = int(rare[0].sum() + head.counts.sum())
        self.distinct = int(rare[1].sum() + (head.counts > 0).sum())


def counted(docs: DataFrame, head: Head, words: float) -> Counted:
    """Fills in the head's counts, and gathers the rest."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(head)
    most = (BANDS - 1) * GROUPS * sizes(int(words))[1]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(words / 4 / RECORDS) + 1)
    fine = 1 << int(np.ceil(np.log2(16 * parts)))
    backs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(words / 30_000_000) + 1)
    wide = (ENDINGS + 1) * 2 * BESIDE

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = shared.value.table, [], 0
        own = np.zeros(len(table.keys) + wide, np.int64)  # counts of the head, then of pairs of endings
        place_of_end = int(np.searchsorted(table.keys, END))
        pairs = own[len(table.keys) :]

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            at = (mix(rows["word"]) & np.uint64(fine - 1)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            blobs = [rows[i:j].tobytes() for i, j in zip(edge, np.append(edge[1:], len(at)), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at[edge], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in sliced(batches):
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            docs = batch.column("_doc").to_numpy().view(np.uint64)
            for first, last, words, endings, bounds, over in word_pieces(*byte_column(batch.column("_text"))):
                row = np.repeat(np.arange(first, last), np.diff(bounds))
                place = table.find(words)
                teaches = train[row]
                own[: len(table.keys)] += np.bincount(place[(place >= 0) & teaches], minlength=len(table.keys))
                if over:
                    own[place_of_end] += train[first:last].sum()
                beside_(pairs, endings, row, teaches, over)
                row, words, endings = row[place < 0], words[place < 0], endings[place < 0]
                order = np.lexsort((words, row))
                row, words, endings = row[order], words[order], endings[order]
                edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (words[1:] != words[:-1]))) if len(row) else np.zeros(0, int)
                some = np.empty(len(edge), RECORD)
                some["word"], some["doc"], some["train"], some["ending"] = words[edge], docs[row[edge]], train[row[edge]], endings[edge]
                some["n"] = np.diff(np.append(edge, len(row)))
                held.append(some)
                size += len(some)
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()
        blocks = [i for i in range(0, len(own), BLOCK) if own[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1 - i // BLOCK for i in blocks], pa.int32()), pa.array([pressed(own[i : i + BLOCK]) for i in blocks], pa.binary())], names=["part", "blob"]
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if part < 0:
                    counts[part] = counts.get(part, 0) + unpressed(blob)
                else:
                    held.append(np.frombuffer(blob.as_buffer(), RECORD))
        for part, n in counts.items():
            yield made(COUNTS, [part], [n.tobytes()])
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        keys, at, word = np.unique(rows["word"], return_index=True, return_inverse=True)
        ending = rows["ending"][at].astype(np.int64)
        count = np.bincount(word, rows["n"] * rows["train"]).astype(np.int64)
        yield made(SIZES, [0], [np.stack([np.bincount(ending, count, ENDINGS), np.bincount(ending, count > 0, ENDINGS)]).astype(np.int64).tobytes()])
        top = np.lexsort((keys, -count))[:most]
        top = top[count[top] > 0]
        best = np.empty(len(top), PAIR)
        best["word"], best["n"], best["ending"] = keys[top], count[top], ending[top]
        yield made(BEST, [0], [best.tobytes()])
        doc, of = np.unique(rows["doc"], return_inverse=True)
        back = np.empty(len(doc), BACK)
        back["doc"], back["known"] = doc, np.bincount(of, rows["n"] * (count[word] > 0))
        back["tail"] = np.bincount(of, rows["n"] * np.log10(count[word] + 1.0))
        at = (mix(doc) % np.uint64(backs)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        back, at = back[order], at[order]
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(edge[1:], len(at))
        for i in range(0, len(edge), 256):
            s = slice(i, i + 256)
            yield made(BACKS, at[edge[s]].tolist(), [back[x:y].tobytes() for x, y in zip(edge[s], ends[s], strict=True)])

    def made(kind: int, part: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "part", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(blob.as_buffer(), BACK) for batch in batches for blob in batch.column("blob")]
        if held:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["known"], rows["tail"], rows["doc"]))]  # sums don't depend on the order they came in
            doc, of = np.unique(rows["doc"], return_inverse=True)
            sums = [np.bincount(of, rows[c]) for c in ("tail", "known")]
            for i in range(0, len(doc), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc[s].view(np.int64)), *[pa.array(x[s]) for x in sums]], names=["doc", "tail", "tail_known"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                rows = np.frombuffer(blob.as_buffer(), PAIR)
                word = (rows["word"] ^ SIGN).view(np.int64)  # signed order is that of the hashes
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(rows["n"].copy()), pa.array(rows["ending"].copy())], names=["word", "n", "ending"])

    blobs = docs.select("_doc", "held_out", "_text").mapInArrow(emit, "part int, blob binary")
    table = written(blobs.repartition(parts, "part").mapInArrow(meet, "kind int, part int, blob binary"), "words")
    own = np.zeros(len(head.counts) + wide, np.int64)
    for r in table.filter(F.col("kind") == COUNTS).collect():
        i = (-1 - r["part"]) * BLOCK
        own[i : i + BLOCK] = np.frombuffer(r["blob"], np.int64)
    head.counts[:] = own[: len(head.counts)]
    rare = np.zeros((2, ENDINGS), np.int64)
    for r in table.filter(F.col("kind") == SIZES).select("blob").toLocalIterator():  # a row for each partition
        rare += np.frombuffer(r["blob"], np.int64).reshape(2, ENDINGS)
    found = table.filter(F.col("kind") == BEST).select("blob").mapInArrow(pairs, "word long, n long, ending long")
    found = found.orderBy(F.desc("n"), "word").limit(most).collect()
    best = np.empty(len(found), PAIR)
    best["word"] = np.array([r["word"] for r in found], np.int64).view(np.uint64) ^ SIGN
    best["n"], best["ending"] = [r["n"] for r in found], [r["ending"] for r in found]
    sums = table.filter(F.col("kind") == BACKS).select("part", "blob").repartition(backs, "part").mapInArrow(gather, "doc long, tail double, tail_known double")
    return Counted(sums, head, rare, best, own[len(head.counts) :].reshape(ENDINGS + 1, 2, BESIDE), table)


def pressed(counts: np.ndarray) -> bytes:
    """Integers as bytes, compressed."""
    small = counts.astype(np.int32) if np.abs(counts).max(initial=0) < 1 << 31 else counts
    return len(counts).to_bytes(4, "little") + bytes([small.itemsize]) + pa.compress(small.tobytes(), "zstd", asbytes=True)


def unpressed(blob: pa.Scalar | bytes) -> np.ndarray:
    raw = blob if isinstance(blob, bytes) else blob.as_buffer().to_pybytes()
    count, size = int.from_bytes(raw[:4], "little"), raw[4]
    return np.frombuffer(pa.decompress(raw[5:], count * size, "zstd"), f"<i{size}").astype(np.int64)


def beside_(pairs: np.ndarray, endings: np.ndarray, row: np.ndarray, teaches: np.ndarray, over: bool) -> None:
    """Adds the pairs of neighbours; ``pairs``: flat counters of ending, side, bucket of the ending beside."""
    if not len(row):
        return
    code = endings.astype(np.int64)
    bucket = code & (BESIDE - 2)  # the last bucket but one's neighbour is the end's own
    same = np.flatnonzero((row[1:] == row[:-1]) & teaches[1:])
    np.add.at(pairs, code[same + 1] * (2 * BESIDE) + bucket[same], 1)
    np.add.at(pairs, code[same] * (2 * BESIDE) + BESIDE + bucket[same + 1], 1)
    last = np.flatnonzero(np.append(row[1:] != row[:-1], over) & teaches)
    np.add.at(pairs, ENDINGS * 2 * BESIDE + bucket[last], 1)
    np.add.at(pairs, code[last] * (2 * BESIDE) + BESIDE + BESIDE - 1, 1)


def grouped(beside: np.ndarray, groups: int = GROUPS, rounds: int = 15) -> np.ndarray:
    """A group for each ending (and, last, the end): k-means on the main axes of square roots of neighbour shares."""
    x = beside.reshape(len(beside), -1).astype(np.float64)
    weight = x.sum(axis=1)
    if not weight.any():
        return np.zeros(len(x), np.int64)
    share = x.sum(axis=0) / weight.sum()
    z = np.sqrt((x + 2 * share) / (weight + 2)[:, None]) - np.sqrt(share)
    _, axes = np.linalg.eigh((z * weight[:, None]).T @ z)
    z = z @ axes[:, -AXES:]
    centres = [z[weight.argmax()]]
    for _ in range(groups - 1):
        far = np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.minimum(weight, 50)
        centres.append(z[far.argmax()])
    centres = np.array(centres)
    near = lambda: ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        of = near()
        for k in range(groups):
            if (w := weight * (of == k)).any():
                centres[k] = w @ z / w.sum()
    return near()


class MaxEnt:
    """Weights over hashed features, for groups, for bands of groups, and for members of bands."""

    def __init__(self, head: Head, rare: np.ndarray, beside: np.ndarray):
        """``rare``: count and number of the training words outside the head, for each ending."""
        by_ending = grouped(beside)
        self.by_ending, self.table = by_ending[:-1], head.table
        tokens = int(rare[0].sum() + head.counts.sum())
        self.rows, self.members = sizes(tokens)
        of = self.by_ending[head.endings]
        place_of_end = int(np.searchsorted(head.table.keys, END))
        of[place_of_end] = by_ending[-1]
        before = head.counts.copy()
        before[place_of_end] = before.max() + 1  # the end is always among the top ones
        order = np.lexsort((head.table.keys, -before))
        order = order[head.counts[order] > 0]
        rank = np.empty(len(order), np.int64)  # of a word among those of its group
        for g in range(GROUPS):
            own = of[order] == g
            rank[own] = np.arange(own.sum())
        keep = rank < (BANDS - 1) * self.members
        top, rank = order[keep], rank[keep]
        count = len(top)
        #: Of each head word its symbol: its place among the top ones, or -1; group, band and member of each symbol.
        self.symbol = np.full(len(head.table.keys) + 1, -1, np.int64)
        self.symbol[top] = np.arange(count)
        self.end = int(self.symbol[place_of_end])
        self.top = count
        self.path = np.zeros((3, count + GROUPS), np.int64)
        self.path[:, :count] = of[top], rank // self.members, rank % self.members
        self.path[0, count:], self.path[1, count:] = np.arange(GROUPS), BANDS - 1
        inside = np.zeros((GROUPS, BANDS, self.members))
        inside[tuple(self.path[:, :count])] = head.counts[top]
        left = self.symbol[:-1] < 0
        counts, number = (np.bincount(self.by_ending, r, GROUPS) + np.bincount(of[left], h[left], GROUPS) for r, h in ((rare[0], head.counts), (rare[1], head.counts > 0)))
        #: Logarithm of what the shares in each group's rare band are shares of.
        self.rest = np.log10(counts + number + 1)
        bands = inside.sum(axis=2)
        bands[:, -1] = counts + 1
        self.widths = (GROUPS, BANDS, self.members)
        with np.errstate(divide="ignore"):
            bias = np.log(bands.sum(axis=1))[None], np.log(bands), np.log(inside.reshape(-1, self.members))
        self.bias = [np.maximum(b - np.log(np.maximum(np.exp(b).sum(axis=1, keepdims=True), 1e-30)), -60).astype(np.float32) for b in bias]
        self.weights = [np.zeros((self.rows, w), np.float32) for w in self.widths]

    def symbols(self, place: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """The symbols of words, found at these places of the head (-1: nowhere)."""
        out = self.symbol[place]
        return np.where(out < 0, self.top + self.by_ending[endings], out)

    @staticmethod
    def features(before: list[np.ndarray]) -> list[np.ndarray]:
        one, two, three = (mix(b.astype(np.uint64) + np.uint64(1)) for b in before)
        return [one * ODD, mix(two + np.uint64(2)), mix(three + np.uint64(3)), mix(one ^ (two * ODD))]

    def node(self, level: int, symbol: np.ndarray) -> np.ndarray:
        """The row of biases that holds for the tokens."""
        if level == 0:
            return np.zeros(len(symbol), np.int64)
        return self.path[0][symbol] if level == 1 else self.path[0][symbol] * BANDS + self.path[1][symbol]

    def places(self, level: int, features: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        """The weight rows of the features."""
        shift, salt = np.uint64(65 - self.rows.bit_length()), mix(node.astype(np.uint64) + np.uint64(77 * level)) | np.uint64(1)
        return [((f * salt) >> shift).astype(np.int64) for f in features]

    def chances(self, level: int, rows: list[np.ndarray], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits less the greatest, [width, tokens], and the logarithm of the sum of their exponentials."""
        weights = self.weights[level]
        z = self.bias[level][node]
        for r in rows:
            z += weights[r]
        z = np.ascontiguousarray(z.T)
        z -= z.max(axis=0)
        return z, np.log(np.exp(z).sum(axis=0))

    def log_probability(self, symbol: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each token's probability (of a rare one: that its group's rare band comes)."""
        out = np.zeros(len(symbol))
        for i in range(0, len(symbol), CHUNK):
            own, features = symbol[i : i + CHUNK], self.features([b[i : i + CHUNK] for b in before])
            for level in range(3):
                some = np.arange(len(own)) if level < 2 else np.flatnonzero(own < self.top)
                node = self.node(level, own[some])
                z, total = self.chances(level, self.places(level, features if level < 2 else [f[some] for f in features], node), node)
                out[i + some] += z[self.path[level][own[some]], np.arange(len(some))].astype(np.float64) - total
        return out


class Sums:
    """What a model expects after each feature, and what came: integers, by level, class and weight row."""

    def __init__(self, model: MaxEnt):
        self.model = model
        self.expected = [np.zeros((w, model.rows)) for w in model.widths]
        self.seen = [np.zeros(w * model.rows, np.int64) for w in model.widths]

    def add(self, symbol: np.ndarray, before: list[np.ndarray]) -> None:
        model, size = self.model, max(TOGETHER, 2 * self.model.rows)
        for i in range(0, len(symbol), size):
            own, features = symbol[i : i + size], model.features([b[i : i + size] for b in before])
            for level, width in enumerate(model.widths):
                some = np.arange(len(own)) if level < 2 else np.flatnonzero(own < model.top)
                if not len(some):
                    continue
                node = model.node(level, own[some])
                rows = model.places(level, features if level < 2 else [f[some] for f in features], node)
                chance = np.empty((width, len(some)), np.float32)
                for j in range(0, len(some), CHUNK):
                    s = slice(j, j + CHUNK)
                    z, total = model.chances(level, [r[s] for r in rows], node[s])
                    chance[:, s] = np.rint(np.exp(z - total) * ONE)
                at, four = np.concatenate(rows), np.empty((len(rows), len(some)))
                for k in range(width):
                    four[:] = chance[k]
                    self.expected[level][k] += np.bincount(at, four.ravel(), model.rows)
                target = model.path[level][own[some]] * model.rows
                for r in rows:
                    np.add.at(self.seen[level], target + r, 1)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for level, (expected, seen) in enumerate(zip(self.expected, self.seen, strict=True)):
            expected = expected.ravel()
            for i in range(0, len(seen), BLOCK):
                if expected[i : i + BLOCK].any() or seen[i : i + BLOCK].any():
                    yield level << 24 | i // BLOCK, pressed(expected[i : i + BLOCK].astype(np.int64)), pressed(seen[i : i + BLOCK])


def moved(weights: np.ndarray, expected: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The weights after a step."""
    expected = expected / ONE
    return weights + (RATE * np.clip((seen - expected) / (expected + SMOOTH), -1, 3)).astype(np.float32)


def trained(docs: DataFrame, model: MaxEnt) -> MaxEnt:
    """The model after ROUNDS of distributed updates, which use each training document once."""
    spark = docs.sparkSession
    train = docs.filter(~F.col("held_out"))
    tasks = max(1, train.rdd.getNumPartitions() * 3 // 8)
    part = F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(ROUNDS))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, *raw in zip(batch.column("block").to_pylist(), batch.column("expected"), batch.column("seen"), strict=True):
                new = [unpressed(r) for r in raw]
                sums[i] = [a + b for a, b in zip(sums[i], new, strict=True)] if i in sums else new
        for i, (expected, seen) in sums.items():
            change = moved(np.zeros(len(seen), np.float32), expected, seen)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([change.tobytes()], pa.binary())], names=["block", "change"])

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, sums = shared.value, None
            for batch in sliced(batches):
                stream = Stream(own.end)
                for _, _, words, endings, bounds, over in word_pieces(*byte_column(batch.column("_text"))):
                    _, token, before = stream.tokens(own.symbols(own.table.find(words), endings), bounds, over)
                    if len(token):
                        sums = sums or Sums(own)
                        sums.add(token, before)
            for block, expected, seen in sums.blocks() if sums else ():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([expected], pa.binary()), pa.array([seen], pa.binary())], names=["block", "expected", "seen"])

        sums = train.filter(part == turn).select("_text").coalesce(tasks).mapInArrow(step, "block int, expected binary, seen binary")
        after = MaxEnt.__new__(MaxEnt)
        after.__dict__ |= model.__dict__ | {"weights": [np.ascontiguousarray(w.T).ravel() for w in model.weights]}
        changes = written(sums.repartition("block").mapInArrow(total, "block int, change binary"), "changes")
        for r in changes.toLocalIterator():
            i = (r["block"] & ((1 << 24) - 1)) * BLOCK
            change = np.frombuffer(r["change"], np.float32)
            after.weights[r["block"] >> 24][i : i + len(change)] += change
        after.weights = [np.ascontiguousarray(w.reshape(-1, model.rows).T) for w in after.weights]
        model = after
        shared.unpersist()
        dropped(spark, changes)
    return model


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns where crc32(doc_id) mod 7 is not 2."""
    spark = docs.sparkSession
    docs = prepared(docs)
    words = (docs.agg(F.sum(F.length("_text"))).first()[0] or 0) / 6
    head = head_words(docs)
    got = counted(docs, head, words)
    rare = got.rare.copy()
    np.subtract.at(rare, (0, got.best["ending"]), got.best["n"])
    np.subtract.at(rare, (1, got.best["ending"]), 1)
    head = head.joined(got.best)
    train_n = got.tokens
    model = MaxEnt(head, rare, got.beside) if train_n else None
    if train_n:
        model = trained(docs, model)
    logs = np.log10(head.counts + 1.0)
    # what documents get by the shuffle is not added here, and taken off the score where the model has the word
    base_of = np.where(head.tailed, 0.0, logs)
    known_of = (head.counts > 0) & ~head.tailed
    if train_n:
        inside = model.symbol[:-1] >= 0
        more_of = np.where(inside, np.where(head.tailed, -logs, 0.0), base_of)
    else:
        more_of = base_of
    shared = spark.sparkContext.broadcast((head.table, model, np.append(base_of, 0.0), np.append(known_of, False), np.append(more_of, 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own, base_of, known_of, more_of = shared.value
        place_of_end = int(np.searchsorted(table.keys, END))
        for batch in sliced(batches):
            count = len(batch)
            tokens, base, seen, score = (np.zeros(count) for _ in range(4))
            stream = Stream(own.end) if own else None
            for first, last, words, endings, bounds, over in word_pieces(*byte_column(batch.column("_text"))):
                size, place = last - first, table.find(words)
                row = np.repeat(np.arange(size), np.diff(bounds))
                tokens[first:last] += np.diff(bounds) + over
                base[first:last] += np.bincount(row, base_of[place], minlength=size) + over * base_of[place_of_end]
                seen[first:last] += np.bincount(row, known_of[place], minlength=size) + over * known_of[place_of_end]
                if own:
                    symbol = own.symbols(place, endings)
                    more = more_of[place]
                    few = symbol >= own.top
                    more[few] -= own.rest[symbol[few] - own.top]
                    score[first:last] += np.bincount(row, more, minlength=size)
                    row, token, before = stream.tokens(symbol, bounds, over)
                    score[first:last] += np.bincount(row, own.log_probability(token, before) / np.log(10), minlength=size)
            columns = [batch.column("doc_id"), batch.column("held_out"), batch.column("_doc")]
            columns += [pa.array(tokens.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "_doc", "n_tokens", "seen", "base", "part"])

    schema = "doc_id long, held_out boolean, _doc long, n_tokens long, seen long, base double, part double"
    found = written(docs.mapInArrow(run, schema), "scores")
    copies = found.groupBy("_doc").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumnRenamed("_doc", "doc")
    sums = got.sums.join(copies, "doc", "left").select("doc", *[(F.col(c) / F.coalesce("copies", F.lit(1))).alias(c) for c in ("tail", "tail_known")])
    out = found.join(sums, F.col("_doc") == F.col("doc"), "left")
    tail = F.coalesce("tail", F.lit(0.0))
    base = F.col("base") + tail - F.col("n_tokens") * F.log10(F.lit(float(train_n + got.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("tail_known", F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(train_n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + tail if train_n else base).alias("score"),
    )
