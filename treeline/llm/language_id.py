"""Language identification by prediction by partial matching.

For each language a context tree of order ORDER over bytes is counted from a bounded sample and frozen.  The code
length of a byte after its context is log2((t + d) / n) where the context was seen with it (n of t times, among d
distinct bytes); otherwise the escape log2((t + d) / d) is paid and the context loses its oldest byte; below order 0 all
bytes are alike.  The language with the shortest code for the whole text wins.

The trees of all languages are merged: one table for each order, of context and byte, holds the finished code length
in every language (escapes included), so most bytes need one lookup.  Lengths are integers in units of 2**-16 bit:
sums don't depend on how a text is cut or batched.

Defined results:
- null texts and texts without a letter: ``und``, score 0; so is everything where no language was learned;
- ties: the language first by code point;
- repeated rows get the same answer, each; long texts are scored whole, in pieces with carried context;
- rows with null lang teach nothing, repeated ones as much as one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.arrays import KeyTable, byte_column, spans_of_bytes
from treeline.llm.common import fold, hashed_unit, long_id, sliced, text_or_empty, tidy

ORDER = 4
UNIT = 1 << 16
#: The learning sample: characters for each language, and for all of them; of a text longer than an eighth of the first
#: a piece of that length is taken, from a hash-drawn place.
SAMPLE_CHARS, SAMPLE_TOTAL = 600_000, 16_000_000
#: A text's confidence is that of so many bytes of it.
CONFIDENT_BYTES = 64
UNKNOWN = "und"
#: Bytes that are looked up together: some 80 bytes of working memory for each.
STEP = 1 << 18


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte its ``order`` bytes of context and itself as one integer; before a text stand zero bytes."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    since = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    for k in range(1, order + 1):
        back = np.zeros_like(wide)
        back[k:] = wide[:-k] if k else wide
        back[since < k] = 0
        out |= back << np.uint64(8 * k)
    return out


class ContextTrees:
    """Frozen trees of several languages; ``lengths`` gives code lengths of texts under each."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        count = len(self.langs)
        seen: list[list[tuple]] = [[] for _ in range(order + 1)]
        for lang in self.langs:
            raw = [t.encode() for t in samples[lang]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            starts = np.cumsum([0, *map(len, raw)])[:-1][[len(r) > 0 for r in raw]].astype(np.int64)
            full = grams(data, starts, order)
            for k in range(order + 1):
                keys, n = np.unique(full & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                contexts, first, d = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
                t = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
                seen[k].append((keys, n, contexts, t, d))
        self.tables: list[KeyTable] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[KeyTable] = []
        self.escapes: list[np.ndarray] = []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([x[0] for x in seen[k]])) if count else np.zeros(0, np.uint64)
            contexts = keys >> np.uint64(8)
            distinct = np.unique(contexts)
            escape = np.zeros((len(distinct), count))
            cost = np.zeros((len(keys), count))
            lower = self._lower(keys, k)
            for i, (own, n, own_contexts, t, d) in enumerate(seen[k]):
                place = np.searchsorted(distinct, own_contexts)
                escape[place, i] = np.log2((t + d) / d)
                cost[:, i] = lower[:, i] + escape[np.searchsorted(distinct, contexts), i]
                of = np.searchsorted(own_contexts, own >> np.uint64(8))
                cost[np.searchsorted(keys, own), i] = np.log2((t + d)[of] / n)
            self.tables.append(KeyTable(keys))
            self.costs.append(np.rint(cost * UNIT).astype(np.int32))
            self.contexts.append(KeyTable(distinct))
            self.escapes.append(np.rint(escape * UNIT).astype(np.int32))

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths, in bits, of the last bytes of ``keys`` one order down (there, all of these were seen)."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        short = keys & np.uint64((1 << 8 * k) - 1)
        return self.costs[k - 1][self.tables[k - 1].find(short)] / UNIT

    def each(self, full: np.ndarray) -> np.ndarray:
        """Code lengths of bytes given by ``grams``: an integer for each byte and language."""
        out = np.zeros((len(full), len(self.langs)), np.int32)
        todo = np.arange(len(full))
        for k in range(self.order, -1, -1):
            keys = full[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            row = self.tables[k].find(keys)
            hit = row >= 0
            if k == self.order:
                out[hit] = self.costs[k][row[hit]]
            else:
                out[todo[hit]] += self.costs[k][row[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            context = self.contexts[k].find(keys >> np.uint64(8))
            known = context >= 0
            out[todo[known]] += self.escapes[k][context[known]]
        out[todo] += 8 * UNIT
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units of 1/UNIT bit."""
        total = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for first, last, begin, end in spans_of_bytes(offsets, STEP):
            lead = min(self.order, begin - int(offsets[first]))  # of a cut text, the context comes along
            starts = np.maximum(offsets[first:last] - (begin - lead), 0)
            filled = np.diff(np.append(starts, end - begin + lead)) > 0
            full = grams(data[begin - lead : end], starts[filled], self.order)
            cost = self.each(full)[lead:]
            if len(cost):
                total[first:last][filled] += np.add.reduceat(cost, np.maximum(starts[filled] - lead, 0), axis=0, dtype=np.int64)
        return total

    def answers(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share among languages, as if the text had CONFIDENT_BYTES) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(letters), np.zeros(len(letters))
        bits = self.lengths(data, offsets) / UNIT
        size = np.maximum(np.diff(offsets), 1)
        more = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, CONFIDENT_BYTES / size)[:, None]
        score = 1 / np.exp2(-more).sum(axis=1)
        best = bits.argmin(axis=1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def learned(docs: DataFrame, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL, order: int = ORDER) -> ContextTrees:
    """Trees from a hash-drawn sample of the rows of ``docs`` (text, lang, doc_id) of a bounded number of characters."""
    rows = docs.filter("text is not null and lang is not null").withColumn("_n", F.length("text")).filter("_n > 0")
    per = rows.groupBy("lang", F.floor(F.log2("_n")).alias("size")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("n")).collect()
    langs = {r["lang"] for r in per}
    if not langs:
        return ContextTrees({}, order)
    each = min(chars, total // len(langs))
    longest = max(each // 8, 1)
    sizes = {lang: sum(min(r["n"], r["rows"] * longest) for r in per if r["lang"] == lang) for lang in langs}
    text = F.xxhash64("text").cast("string")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    share = F.create_map(*[x for lang in sorted(sizes) for x in (F.lit(lang), F.lit(min(1.0, each / sizes[lang])))])
    rows = rows.filter(hashed_unit("lang", key) < share[F.col("lang")])
    begin = F.floor(hashed_unit("piece", text) * (F.greatest(F.col("_n") - longest, F.lit(0)) + 1)).cast("int") + 1
    pieces = rows.select("lang", F.substring("text", begin, F.lit(longest)).alias("text")).distinct()
    samples: dict[str, list[str]] = {}
    for r in pieces.toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"])
    return ContextTrees({k: sorted(v) for k, v in samples.items()}, order)


def predicted(docs: DataFrame, trees: ContextTrees, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(c) for c in keep], text_or_empty().alias("_text"), letters.alias("_letters"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = byte_column(batch.column("_text"))
            found = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            langs, score = model.value.answers(data, offsets, found)
            columns = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(tidy(answer), schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns where crc32(doc_id) mod 4 is not 2."""
    docs = docs.select(long_id(docs).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trees = learned(docs.filter(fold(4) != 2))
    out = predicted(docs.withColumn("held_out", fold(4) == 2).drop("lang"), trees, ["doc_id", "held_out"])
    return out


#: Rows whose language is this uncertain, or unknown, are rejected.
LEAST_SCORE = 0.5


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in one of its languages, all their columns.

    Where no document names its language, none was learned, and only texts without letters are rejected.
    """
    trees = learned(docs.filter(fold(4) != 2))
    if not trees.langs:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    out = predicted(rows, trees, names).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return out.select(*names).toDF(*docs.columns)
