"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised on its own, as if it began a text.  Where a
pre-token boundary of one chunk is also a boundary of the next, both go on alike: the pattern only looks forward.  So
the chunks are stitched at the first such place; the few whose overlap has none are pre-tokenised again as one longer
chunk.  Then each pre-token is encoded, by its merges; decoding concatenates the raw bytes of the ids.

Defined results:
- null text is empty: no ids; an empty table gives an empty result;
- bytes that are no UTF-8 after decoding (of ids cut anywhere) are replaced in ``text``, kept whole in ``raw``;
- repeated rows are encoded each; long texts whole; strings of special tokens are ordinary text;
- further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import long_id, sliced, text_or_empty, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 1 << 12, 1 << 8
#: A boundary this far before a chunk's end doesn't depend on what follows: no alternative looks further ahead.
LOOK = 8
#: Pre-tokens of up to so many characters are remembered, so many at most.
SHORT, REMEMBERED = 32, 100_000
THREADS = 2
#: Texts of more chunks than this are pre-tokenised by the threads.
CHUNKS_POOLED = 16


def pre_tokens(text: str, pattern: regex.Pattern, begin: int, end: int) -> list[tuple[int, int]]:
    """Matches in text[begin:end] as if nothing else were there; places are those in ``text``."""
    return [(m.start() + begin, m.end() + begin) for m in pattern.finditer(text[begin:end], concurrent=True)]


def stitched(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP, pool: ThreadPoolExecutor | None = None) -> list[tuple[int, int]]:
    """The matches of ``pattern`` in the whole text, by overlapping chunks.

    Where chunks have no common boundary, a stretch from the last sure one is matched again; each such stretch is at
    least twice as long as what it replaces, so the work stays in proportion to the text.
    """
    size = len(text)
    cuts = [(at, min(size, at + chunk + overlap)) for at in range(0, max(size, 1), chunk)]
    parts = list((pool.map if pool and len(cuts) > CHUNKS_POOLED else map)(lambda cut: pre_tokens(text, pattern, *cut), cuts))
    out, limit, n = parts[0], cuts[0][1], 1
    while limit < size:
        (begin, end), part = cuts[n], parts[n]
        starts = {a: i for i, (a, _) in enumerate(part)}
        keep = len(out)
        while keep and out[keep - 1][1] > limit - LOOK:
            keep -= 1
        last, meet = keep, None
        while last and out[last - 1][1] > begin:  # the meeting place nearest the end serves as well as the first
            if out[last - 1][1] in starts:
                meet = last
                break
            last -= 1
        if meet is None:
            from_ = out[keep - 1][1] if keep else 0
            while cuts[n][1] < min(size, from_ + 2 * (limit - from_)):
                n += 1
            end = cuts[n][1]
            del out[keep:]
            out += pre_tokens(text, pattern, from_, end)
        else:
            at = out[meet - 1][1]
            del out[meet:]
            out += part[starts[at] :]
        limit, n = end, n + 1
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranks; ``source``: the bytes of its file."""

    def __init__(self, source: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.splitlines() if line)}
        #: Merges what it is given as one piece; pre-tokens are found here.
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pool = ThreadPoolExecutor(THREADS)

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (ids := self.known.get(text)) is None:
            ids = tuple(self.core.encode_ordinary(text))
            if len(text) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out: list[int] = []
        known, more = self.known, out.extend
        for a, b in stitched(text, self.pattern, chunk, overlap, self.pool):
            token = text[a:b]
            more(known.get(token) or self.piece(token))
        return out

    def decode(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])


_made: dict[int, ByteBPE] = {}


def shared(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> Broadcast:
    """The vocabulary file and pattern for the executors; its size doesn't depend on the data."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def coder(of: Broadcast) -> ByteBPE:
    """One coder for each worker and vocabulary."""
    if (key := hash(of.value)) not in _made:
        _made[key] = ByteBPE(*of.value)
    return _made[key]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens (ids)."""
    of = shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = [coder(of).encode(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "n_tokens", "tokens"],
            )

    return docs.select(long_id(docs).alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, tokens array<int>"
    )


def decoded(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, raw (the bytes), text of rows with doc_id and tokens; null tokens are none."""
    of = shared(rows.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [coder(of).decode(ids or []) for ids in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())],
                names=["doc_id", "raw", "text"],
            )

    return rows.select("doc_id", "tokens").mapInArrow(tidy(run), "doc_id long, raw binary, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and its ids are decoded, in one pass."""
    of = shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count, of_ids, of_bytes = [], [], []
            for text in batch.column("_text"):
                ids = coder(of).encode(text.as_py())
                count.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(coder(of).decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(long_id(docs).alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
