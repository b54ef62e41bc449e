"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits and bytes above ASCII, lower-cased, with its ends marked.  Its byte n-grams of 3 to 6
hash to embedding rows, so a misspelling never seen shares most of its vectors with the word that was.  The embeddings
of all n-grams of a window of words are averaged into a softmax over two classes; the most toxic window decides for the
whole text, as a few words make a long document toxic.  Labels are known for documents only, so learning goes in
two rounds: first every window has its document's label, then only the windows of a toxic document that stand out to a
model of other documents keep it.
A logistic curve over the training documents turns the greatest window logit into the score.

Defined results:
- null and empty texts, and texts without words, get the score of the bias alone (a clean one);
- labels: rows of null doc_id or null label teach nothing; of several labels for a document the largest counts;
- without any toxic or any clean label everything scores 0;
- repeated rows get the same answer, each; ties play no part; long texts are scored whole, in pieces cut between words;
- an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.arrays import byte_column
from treeline.llm.common import fold, hashed_unit, long_id, sliced, text_or_empty, written

#: Embedding rows (a power of two), their width, n-gram lengths, words in a half window.
BUCKETS, WIDTH, LENGTHS, HALF = 1 << 18, 8, (3, 4, 5, 6), 1
#: The learning sample: documents of each label, and characters of them; of a text longer than the last, a piece of that
#: length is taken, from a hash-drawn place.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LONGEST = 1_500, 2_000_000, 32_768
THRESHOLD = 0.7
STEP = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_INSIDE = _WORD.copy()
_INSIDE[65:91] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; bytes that belong to no word become spaces."""
    out = data + (32 * ((data >= 65) & (data <= 90))).astype(np.uint8)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    out[~_WORD[out]] = 32
    return out


def word_cuts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Work of about ``most`` bytes: (first row, row after the last, from byte, to byte).  A longer row is cut after words;
    each further piece of it begins with the last word of the one before, so that no pair of words is lost."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        if last > row:
            yield row, last, int(offsets[row]), int(offsets[last])
            row = last
            continue
        at, over = int(offsets[row]), int(offsets[row + 1])
        while True:
            end = min(at + most, over)
            while end < over and _INSIDE[data[end]]:
                gap = np.flatnonzero(~_INSIDE[data[end : min(end + 4096, over)]])
                end = end + int(gap[0]) if len(gap) else min(end + 4096, over)
            yield row, row + 1, at, end
            if end == over:
                break
            back = end
            while back > at and not _INSIDE[data[back - 1]]:
                back -= 1
            while back > at and _INSIDE[data[back - 1]]:
                back -= 1
            at = back if back > at else end
        row += 1


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that begin at ``starts``: the bucket and half window of each n-gram; the text of each half window."""
    size = len(data)
    text = np.full(size + len(starts) + 1, 32, np.uint8)  # a space before each text
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, size)))
    text[np.arange(size) + of + 1] = lowered(data)
    blank = text == 32
    places = np.arange(len(text), dtype=np.int64)
    until = np.where(blank, places, len(text))
    until = np.minimum.accumulate(until[::-1])[::-1]  # the next blank, here or after
    begins = blank[:-1] & ~blank[1:]
    at = np.flatnonzero(begins)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    owner = np.searchsorted(starts + np.arange(len(starts)), at, side="right") - 1
    order = np.arange(len(at)) - np.searchsorted(owner, owner)  # of the word in its text
    fresh = np.append(True, (owner[1:] != owner[:-1])) | (order % HALF == 0)
    half = np.cumsum(fresh) - 1
    halves = owner[fresh]
    word = np.cumsum(begins) - 1  # of each place, but for the last
    code = text.astype(np.uint64)
    rolled = code.copy()
    buckets, where = [], []
    for n in range(2, max(LENGTHS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + code[n - 1 :]
        if n in LENGTHS:
            ok = np.flatnonzero(until[1 : len(rolled) + 1] >= places[: len(rolled)] + n - 1)
            buckets.append((((rolled[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int32))
            where.append(half[word[ok]].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(where), halves


class SubwordBag:
    """The trained model: a logit for each bucket (its embedding times the softmax weights), bias, logistic curve."""

    def __init__(self, logits: np.ndarray, bias: float, slope: float, shift: float):
        self.logits, self.bias, self.slope, self.shift = logits, bias, slope, shift

    def windows(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text and the logit of each window: of a half window alone, or with the next, whichever is greater."""
        buckets, half, owner = features(data, starts)
        if not len(owner):
            return owner, np.zeros(0)
        total = np.bincount(half, self.logits[buckets], minlength=len(owner))
        count = np.bincount(half, minlength=len(owner))
        next_ = np.append(owner[1:] == owner[:-1], False)
        both = (total + np.where(next_, np.append(total[1:], 0), 0)) / np.maximum(count + np.where(next_, np.append(count[1:], 0), 0), 1)
        return owner, np.maximum(total / np.maximum(count, 1), both) + self.bias

    def greatest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The greatest window logit of each text, the bias at least."""
        out = np.full(len(offsets) - 1, self.bias)
        for first, last, begin, end in word_cuts(data, offsets, STEP):
            owner, logit = self.windows(data[begin:end], np.maximum(offsets[first:last] - begin, 0))
            np.maximum.at(out, owner + first, logit)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.greatest(data, offsets) + self.shift, -50, 50)))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


class Windows:
    """The half windows of the sample with their n-grams, and the gradient steps that fit embeddings and softmax."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, seed: int):
        buckets, half, self.owner = features(data, starts)
        order = np.argsort(half, kind="stable")
        self.buckets, half = buckets[order], half[order]
        self.at = np.searchsorted(half, np.arange(len(self.owner) + 1))
        self.random = np.random.default_rng(seed)

    def fit(self, chosen: np.ndarray, target: np.ndarray, epochs: int, rate: float) -> tuple[np.ndarray, float]:
        """A logit for each bucket and the bias, from the half windows ``chosen`` with classes ``target``."""
        random, at = self.random, self.at
        vectors = random.uniform(-0.02, 0.02, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
        weights = random.normal(0, 1, (WIDTH, 2)).astype(np.float32)
        bias, power = np.zeros(2, np.float32), np.full(BUCKETS, 1e-6, np.float32)
        chosen = chosen[at[chosen + 1] > at[chosen]].copy()
        heavy = min(4.0, (target[chosen] == 0).sum() / max(1, (target[chosen] == 1).sum()))
        for _ in range(epochs):
            random.shuffle(chosen)
            for batch in np.array_split(chosen, max(1, len(chosen) // 512)):
                count = at[batch + 1] - at[batch]
                begin = np.concatenate([[0], np.cumsum(count)])
                ids = self.buckets[np.arange(begin[-1]) + np.repeat(at[batch] - begin[:-1], count)]
                mean = np.add.reduceat(vectors[ids], begin[:-1], axis=0) / count[:, None]
                z = mean @ weights + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), target[batch]] -= 1
                p *= np.where(target[batch] == 1, heavy, 1.0)[:, None] / len(batch)
                rows, back = np.unique(ids, return_inverse=True)
                grad = (p @ weights.T / count[:, None]).astype(np.float32)
                sums = np.stack([np.bincount(back, np.repeat(grad[:, j], count), minlength=len(rows)) for j in range(WIDTH)], axis=1)
                power[rows] += (sums**2).mean(axis=1)
                vectors[rows] -= (rate * sums / np.sqrt(power[rows])[:, None]).astype(np.float32)
                weights -= rate * 0.5 * (mean.T @ p)
                bias -= rate * 0.5 * p.sum(axis=0)
        gap = weights[:, 1] - weights[:, 0]
        return (vectors @ gap).astype(np.float32), float(bias[1] - bias[0])

    def logits(self, of: np.ndarray) -> np.ndarray:
        """The mean of its n-grams' logits ``of`` for each half window."""
        total = np.concatenate([[0.0], np.cumsum(of[self.buckets], dtype=np.float64)])
        return (total[self.at[1:]] - total[self.at[:-1]]) / np.maximum(np.diff(self.at), 1)


def trained(texts: list[str], labels: np.ndarray, odds: float | None = None, epochs: int = 2, rate: float = 0.1, seed: int = 7) -> SubwordBag:
    """Two rounds: models of either half of the sample judge the windows of the other half; the final one learns from
    the windows of clean documents and those of toxic documents that such a model found unlike clean ones.  ``odds``:
    toxic to clean documents where the sample comes from, if it was drawn at other odds; scores are set right for them.
    """
    if not len(texts) or labels.min() == labels.max():
        return SubwordBag(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -50.0)
    data, offsets = joined(texts)
    windows = Windows(data, offsets[:-1], seed)
    owner, labels = windows.owner, labels.astype(np.int64)
    target = labels[owner]
    side = np.array([zlib.crc32(t[:64].encode("utf-8", "replace")) & 1 for t in texts])[owner]
    stands = np.zeros(len(owner), bool)
    for own in (0, 1):
        of, _ = windows.fit(np.flatnonzero(side == own), target, epochs, rate)
        judged = windows.logits(of)
        clean = judged[(side != own) & (target == 0)]
        if len(clean):
            stands |= (side != own) & (target == 1) & (judged > np.quantile(clean, 0.999))
    target = (target == 1) & stands
    of, bias = windows.fit(np.flatnonzero((labels[owner] == 0) | target), target.astype(np.int64), 4 * epochs, rate)
    model = curved(SubwordBag(of, bias, 1.0, 0.0), data, offsets, labels)
    if odds:
        model.shift += float(np.log(odds) - np.log(labels.mean() / (1 - labels.mean())))
    return model


def curved(model: SubwordBag, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> SubwordBag:
    """The logistic curve from the greatest window logit to the label, by Newton's steps with a weak prior."""
    x = model.greatest(data, offsets)
    centre, spread = x.mean(), x.std() + 1e-9
    x = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (p - labels) + 0.1 * w)
    slope = max(w[0], 0.0) / spread
    return SubwordBag(model.logits, model.bias, float(slope), float(w[1] - slope * centre))


def learned(docs: DataFrame, labels: DataFrame, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS, longest: int = SAMPLE_LONGEST) -> SubwordBag:
    """A model from a hash-drawn sample of labelled documents; documents and characters are bounded, texts of any length
    may enter."""
    own = labels.select(long_id(labels).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return trained([], np.zeros(0, int))
    share = lambda most: F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(min(1.0, most[k])))])[F.col("toxic")]
    draw = hashed_unit("toxic", F.col("doc_id").cast("string"))
    drawn = own.filter(draw < share({k: docs_each / n for k, n in sizes.items()}))  # docs_each of each label: bounded
    text, size = F.col("text").cast("string"), F.length(F.col("text").cast("string"))
    begin = F.floor(hashed_unit("piece", F.xxhash64(text).cast("string")) * (F.greatest(size - longest, F.lit(0)) + 1)).cast("int") + 1
    rows = docs.filter(size > 0).select(long_id(docs).alias("doc_id"), F.substring(text, begin, F.lit(longest)).alias("text"))
    rows = written(rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").distinct(), "labelled")
    chars = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    own_draw = hashed_unit("chars", F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")))
    few = rows.filter(own_draw < share({k: chars_each / chars.get(k, 1) for k in (0, 1)}))
    sample = [tuple(r) for r in few.orderBy(own_draw, "doc_id").limit(4 * docs_each).collect()]  # one id may have many rows
    sample.sort()
    return trained([t for _, t, _ in sample], np.array([y for _, _, y in sample], int), sizes[1] / sizes[0])


def scored(docs: DataFrame, model: SubwordBag, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and predicted."""
    of = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            score = of.value.score(*byte_column(batch.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return docs.select(*keep, text_or_empty().alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns where crc32(doc_id) mod 3 is not 1."""
    docs = docs.select(long_id(docs).alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learned(docs.filter(fold(3) != 1), labels.filter(fold(3) != 1))
    return scored(docs.withColumn("held_out", fold(3) == 1), model, ["doc_id", "held_out"])
