"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, its turns between marks, and encoded once with offsets; the marks are tokens of
their own, so no token lies across a turn's end.  The loss mask comes from the sorted spans of the assistant texts: a
binary search over the sorted token spans finds the first and last token of each.

Control strings inside texts and roles are escaped reversibly: each backslash is doubled, and a control string gets a
backslash after its first character, so it no longer occurs as such.

Defined results:
- null text and null role are empty; null turns come first; ties of a turn are ordered by role, then text;
- rows of null conv_id form a conversation of their own; repeated rows are turns each;
- a conversation longer than PART characters is rendered in parts that end with a turn: memory stays bounded;
- an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

from treeline.llm.common import long_id, sliced

VOCABULARY = "byte_bpe_50k.json"
#: Marks around a turn of each role; of any other role, whose name comes between the first two.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
MARKS = (*[m for pair in TURNS.values() for m in pair], *OTHER)
LEARNED_ROLE = "assistant"
PART = 1 << 20
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(m) for m in MARKS))
_MARK = re.compile("|".join(re.escape(m) for m in MARKS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of the texts to learn."""
    parts, spans, size = [], [], 0
    for role, text in turns:
        if role in TURNS:
            before, after = TURNS[role]
        else:
            before, after = OTHER[0] + escaped(role) + OTHER[1], OTHER[2]
        body = escaped(text)
        if role == LEARNED_ROLE:
            spans.append((size + len(before), size + len(before) + len(body)))
        parts += (before, body, after)
        size += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of ``rendered``."""
    opening = {pair[0]: role for role, pair in TURNS.items()}
    out, role, begin = [], "", 0
    for m in _MARK.finditer(formatted):
        if m[0] in opening:
            role, begin = opening[m[0]], m.end()
        elif m[0] == OTHER[0]:
            begin = m.end()
        elif m[0] == OTHER[1]:
            role, begin = unescaped(formatted[begin : m.start()]), m.end()
        else:
            out.append((role, unescaped(formatted[begin : m.start()])))
    return out


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in a span; tokens and spans are sorted, so two binary searches find each span's."""
    mask = np.zeros(len(starts), bool)
    if spans:
        first = np.searchsorted(ends, [a for a, _ in spans], side="right")
        after = np.searchsorted(starts, [b for _, b in spans], side="left")
        for a, b in zip(first, after, strict=True):
            mask[a:b] = True
    return mask


@dataclass
class Part:
    """A formatted conversation (or a part of a very long one) as it is written out."""

    conv_id: int | None
    number: int
    formatted: str
    tokens: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    loss: np.ndarray

    def learned(self) -> list[str]:
        """The texts under the mask, unescaped, in order."""
        out = []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.loss.astype(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2):
            out.append(unescaped(self.formatted[self.starts[a] : self.ends[b - 1]]))
        return out


class Formatter:
    def __init__(self, source: str):
        """``source``: the tokenizer's JSON."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.core = Tokenizer.from_str(source)
        self.core.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        self.core.post_processor = processors.ByteLevel(trim_offsets=False)
        self.core.add_tokens([AddedToken(m, normalized=False, special=False) for m in MARKS])
        self.core.encode_special_tokens = True  # the vocabulary's own special strings are ordinary text

    def part(self, conv_id: int | None, number: int, turns: list[tuple[str, str]]) -> Part:
        text, spans = rendered(turns)
        got = self.core.encode(text, add_special_tokens=False)
        places = np.array(got.offsets, np.int64).reshape(-1, 2)
        starts, ends = places[:, 0], places[:, 1]
        return Part(conv_id, number, text, np.array(got.ids, np.int32), starts, ends, masked(starts, ends, spans))

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, bool]]:
        """The parts of conversations whose rows come sorted, with whether a conversation ends; holds one part at most."""
        turns: list[tuple[str, str]] = []
        conv, number, size, begun = None, 0, 0, False
        for batch in sliced(batches):
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if begun and key != conv:
                    yield self.part(conv, number, turns), True
                    turns, number, size = [], 0, 0
                elif size > PART:
                    yield self.part(conv, number, turns), False
                    turns, number, size = [], number + 1, 0
                conv, begun = key, True
                turns.append((role, text))
                size += len(text)
        if begun:
            yield self.part(conv, number, turns), True


_made: dict[int, Formatter] = {}


def formatter(of: Broadcast) -> Formatter:
    if (key := hash(of.value)) not in _made:
        _made[key] = Formatter(of.value)
    return _made[key]


def shared(spark: SparkSession, path: str | None = None) -> Broadcast:
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def ordered(rows: DataFrame) -> DataFrame:
    """Each conversation's rows together, sorted; the sort spills, so no conversation is too long for it."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = rows.select(long_id(rows, "conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def formatted(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, part, formatted, tokens, starts, ends, loss (of each token) of conversations (conv_id, turn, role, text)."""
    of = shared(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _ in formatter(of).parts(batches):
            columns = [[p.conv_id], [p.number], [p.formatted], [p.tokens.tolist()], [p.starts.tolist()], [p.ends.tolist()], [p.loss.tolist()]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "part", "formatted", "tokens", "starts", "ends", "loss"],
            )

    schema = "conv_id long, part int, formatted string, tokens array<int>, starts array<int>, ends array<int>, loss array<boolean>"
    return ordered(rows).mapInArrow(run, schema)


def digests(rows: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, read back from the parts."""
    of = shared(rows.sparkSession, path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        said, learned, turns, chars, size, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
        for p, over in formatter(of).parts(batches):
            for role, text in parsed(p.formatted):
                said.update(f"{role}\n{text}\n".encode())
                turns += 1
            for text in p.learned():
                learned.update(text.encode())
                chars += len(text)
            size += len(p.formatted)
            tokens += len(p.tokens)
            if over:
                out.append((p.conv_id, turns, said.hexdigest(), chars, learned.hexdigest(), size, tokens))
                said, learned, turns, chars, size, tokens = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    return ordered(rows).mapInArrow(run, schema)


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose texts are made of control strings."""
    first = F.col("id") == 0
    probe = rows.sparkSession.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(first, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select(long_id(rows, "conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
