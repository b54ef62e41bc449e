"""Personal data by a semi-Markov conditional random field over candidate segments.

A text is looked at where digits, an @ or a spelled-out at stand.  There its tokens (letter runs, digit runs, single
marks) are cut into segments: an entity of up to LONGEST tokens, or one token of other text.  Features describe a whole
segment: its shape, count of digits, check sum, octets, what stands before and after.  Dynamic programming over the
bounded segments finds the best boundaries and types together.  The four base patterns are fixed segments; the field
adds what they miss (a phone number without country code, a spelled-out address, a card with other separators) and
secrets: runs of letters and digits mixed, such as access keys, tokens and passwords.

It is trained here by gradient ascent of the conditional likelihood, on texts made from words of a bounded sample of
the documents with entities and look-alikes put in, and on the sample's own base matches.

Defined results:
- null text is empty: no spans; an empty table gives an empty result;
- spans are in code points, the end exclusive; base spans are leftmost and non-overlapping for each kind, but kinds may
  overlap each other; an added span overlaps no base span;
- ties between segmentations: other text wins, then the kind listed first;
- repeated rows are each answered; long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import hashed_unit, long_id, sliced, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that have base patterns.
BASE_KINDS = KINDS[:4]
#: Characters of the shortest run of mixed letters and digits that may be a secret.
LEAST_MIXED = 16
#: Tokens of the longest entity; feature rows (a power of two); documents in the sample, none longer than so many characters.
LONGEST, ROWS, SAMPLE_DOCS, SAMPLE_LONGEST = 20, 1 << 15, 300, 8_000
#: Digits of a number that can be an entity (with three dots, fewer will do).
LEAST_DIGITS, MOST_DIGITS = 7, 20
#: Log-odds that an added span must have over other text.
MARGIN = 2.0
AROUND, APART = 32, 24
#: Tokens whose candidates are scored together.
TOKENS = 1 << 12

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails at the first digit of a run fails at the others too, so runs are tried once: time stays linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
_TOKEN = re.compile(rf"(?=[A-Za-z0-9]{{{LEAST_MIXED}}})(?:[A-Za-z]++[0-9]|[0-9]++[A-Za-z])[A-Za-z0-9]*+|[^\W\d_]+|[0-9]+|\S")
_MAIL = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)* ?(?:@|\[ ?at ?\]|\( ?at ?\)) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMERIC = frozenset("+().-/ ")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The matches of the four patterns, by kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        over = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > over and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                over = m.end()
                out.append(("email", start, over))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches around digits and at-signs, widened to white space or an end of the text."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= APART + 2 * AROUND:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    wide: list[tuple[int, int]] = []
    for a, b in out:
        over, start = wide[-1][1] if wide else 0, max(0, a - AROUND)
        while start > over and not text[start - 1].isspace():
            start -= 1
        end = max(over, min(len(text), b + AROUND))
        while end < len(text) and not text[end].isspace():
            end += 1
        if wide and start <= over:
            wide[-1] = (wide[-1][0], end)
        else:
            wide.append((start, end))
    return wide


Token = tuple[int, int, str]
Segment = tuple[int, int, list[int]]


class Covered:
    """Which stretches of a text some spans cover."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda x: x[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        n = bisect.bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a


def candidates(text: str, tokens: list[Token], taken: list[bool], first: int, last: int) -> Iterator[Segment]:
    """Segments (first token, token after the last, feature rows) that may be entities and begin at tokens first to last - 1."""
    count = len(tokens)
    for i in range(first, last):
        word = tokens[i][2]
        if taken[i] or not (word[0].isalnum() or word in "+("):
            continue
        if mixed(word):
            yield i, i + 1, rows_of(text, tokens, i, i + 1)
        numeric = word[0] in "+(" or (word.isascii() and word.isdigit())
        spelled, gaps, digits, dots = False, 0, 0, 0
        for j in range(i, min(count, i + LONGEST)):
            a, _, w = tokens[j]
            if taken[j]:
                break
            if j > i and (gap := a - tokens[j - 1][1]):
                gaps += 1
                if gap > 1 or gaps > 8:
                    break
            digit = w.isascii() and w.isdigit()
            numeric = numeric and (digit or w in _NUMERIC)
            digits, dots = digits + digit * len(w), dots + (w == ".")
            if digits > MOST_DIGITS and not spelled:
                break
            spelled = spelled or w == "@" or (w == "at" and j > i)
            if (numeric and digit and (digits >= LEAST_DIGITS or dots == 3)) or (spelled and j - i >= 4 and w[0].isalnum() and w != "at"):
                yield i, j + 1, rows_of(text, tokens, i, j + 1)


def mixed(word: str) -> bool:
    """Whether a token is a run of letters and digits that may be a secret."""
    return len(word) >= LEAST_MIXED and word.isascii() and word.isalnum() and not word.isalpha() and not word.isdigit()


def rows_of(text: str, tokens: list[Token], i: int, j: int) -> list[int]:
    a, b = tokens[i][0], tokens[j - 1][1]
    k = i - 1
    if mixed(text[a:b]):
        while k > max(0, i - 4) and tokens[k][2] in "=:\"'":  # to the word that names it
            k -= 1
    return feature_rows(text[a:b], text[a - 1] if a else " ", text[b : b + 2], tokens[k][2].lower()[:20] if i else "", j - i)


def lattices(text: str, begin: int, end: int, covered: Covered) -> Iterator[tuple[list[Token], list[Segment]]]:
    """Tokens of a region and its candidates, some tokens at a time: each part's tokens begin with the one before its
    first start, but for the region's first, and go LONGEST beyond its last."""
    stream = ((m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, begin, end))
    tokens, first = list(itertools.islice(stream, TOKENS + LONGEST)), 0
    while tokens:
        last = min(len(tokens), first + TOKENS)
        taken = [covered.touches(a, b) for a, b, _ in tokens]
        yield tokens, list(candidates(text, tokens, taken, first, last))
        if last == len(tokens):
            return
        tokens = tokens[last - 1 :] + list(itertools.islice(stream, TOKENS))
        first = 1


@functools.lru_cache(20_000)
def feature_rows(span: str, before: str, after: str, word: str, size: int) -> list[int]:
    """The weight rows of a candidate between what stands before and after it."""
    digits = "".join(_DIGITS.findall(span))
    shape = re.sub(r"[^\W\d_]+", "a", _DIGITS.sub(lambda m: f"d{len(m[0])}", span))
    coarse = re.sub(r"d\d+", "d", shape)
    parts = span.split(".")
    checks = f"{luhn(digits) if 13 <= len(digits) <= 19 else '-'}{len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}"
    glued = ("x" if before.isalnum() else before if before in "+(.-@$#=\"/:,_" else " ") + (
        "x" if after[:1].isalnum() else after if after[:1] in ".-@/:,_)" and after[1:2].isalnum() else " "
    )
    at = span.count("@") + len(re.findall(r"[\[( ]at[\]) ]", span))
    told = [
        "bias", f"shape {shape}", f"coarse {coarse}", f"digits {len(digits)}", f"checks {checks} {len(digits) >= 13}",
        f"glued {glued}", f"first {span[0] if not span[0].isalpha() else 'a'} {min(len(digits), 16)}", f"word {word}",
        f"at {at} {'.' in span.rpartition('@')[2]}", f"mail {bool(_MAIL.fullmatch(span))} {glued}", f"runs {len(_DIGITS.findall(span))} {len(digits)}", f"size {min(size, 20)}",
    ]
    if mixed(span):  # of these, what stands in for the shape
        runs = len(_DIGITS.findall(span))
        told[1:4] = f"hex {not span.lower().strip('0123456789abcdef')} {span.isupper()} {span.islower()}", f"share {len(digits) * 5 // len(span)} {min(runs, 5)}", f"length {min(len(span), 44)} {runs > 2}"
        told[6] = f"start {span[:4]}"
    return [zlib.crc32(x.encode()) % ROWS for x in told]


class SemiMarkov:
    """Feature weights for each kind; other text scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def likely(self, segments: list[Segment]) -> list[tuple[int, int, int, float]]:
        """First token, token after the last, kind and log-odds of the segments that beat other text."""
        if not segments:
            return []
        scores = self.weights[np.array([r for _, _, r in segments])].sum(axis=1) - MARGIN
        kind = scores.argmax(axis=1)
        best = scores[np.arange(len(kind)), kind]
        return [(*segments[n][:2], int(kind[n]), float(best[n])) for n in np.flatnonzero(best > 0)]

    def entities(self, text: str, begin: int, end: int, covered: Covered) -> list[Span]:
        """The entities of a region's best segmentation.  Stretches that no likely segment crosses are solved by themselves."""
        out: list[Span] = []
        held: list[tuple[int, int, int, float]] = []  # likely segments that overlap, as characters
        over = 0
        for tokens, segments in lattices(text, begin, end, covered):
            for i, j, kind, score in self.likely(segments):
                a, b = tokens[i][0], tokens[j - 1][1]
                if held and a >= over:
                    out += best(held)
                    held = []
                held.append((a, b, kind, score))
                over = max(over, b) if len(held) > 1 else b
        return out + best(held)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and those with the added ones; each by kind, then start."""
        base = base_spans(text)
        covered, added = Covered(base), []
        for begin, end in regions(text):
            added += self.entities(text, begin, end, covered)
        order = {k: i for i, k in enumerate(KINDS)}
        return base, sorted(base + added, key=lambda x: (order[x[0]], x[1], x[2]))


def best(segments: list[tuple[int, int, int, float]]) -> list[Span]:
    """The disjoint segments (start, end, kind, log-odds above 0) of the greatest sum, by dynamic programming over their
    ends; of equal sums the one with other text, then the one that begins first."""
    ends = sorted({b for _, b, _, _ in segments})
    value, back = [0.0], [None]
    by_end: dict[int, list[tuple[int, int, int, float]]] = {}
    for x in segments:
        by_end.setdefault(x[1], []).append(x)
    for t, b in enumerate(ends, 1):
        value.append(value[t - 1])
        back.append(None)
        for x in sorted(by_end[b]):
            if (v := value[bisect.bisect_right(ends, x[0])] + x[3]) > value[t]:
                value[t], back[t] = v, x
    out, t = [], len(ends)
    while t:
        if back[t] is None:
            t -= 1
        else:
            a, b, kind, _ = back[t]
            out.append((KINDS[kind], a, b))
            t = bisect.bisect_right(ends, a)
    return out[::-1]


def example(rnd: random.Random, words: list[str]) -> tuple[str, list[Span]]:
    """A line of text with entities, or things that look like them, and the entities' spans."""
    n = lambda k: "".join(rnd.choices("0123456789", k=k))
    name = lambda: rnd.choice(words).lower()[:9] or "x"

    def card() -> str:
        body = rnd.choice("3456") + n(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    hexed = lambda k: "".join(rnd.choices("0123456789abcdef", k=k))
    any_ = lambda k: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=k))

    def secret() -> tuple[str, str]:
        """What comes before it, and itself."""
        named = rnd.choice(["password=", "token=", "token = \"", "secret: ", "key=", "api key: ", "pwd=\"", "passwd: ", "auth token "])
        return rnd.choice([
            lambda: (named, hexed(rnd.choice([16, 18, 20, 24, 32, 40, 64]))), lambda: (named, any_(rnd.randint(16, 44))),
            lambda: (rnd.choice(["", "", named]), rnd.choice(["AKIA", "ASIA"]) + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))),
            lambda: (rnd.choice(["", named]), any_(rnd.randint(28, 44))),
        ])()

    def entity() -> tuple[str, str]:
        kind = rnd.choice(BASE_KINDS)
        if kind == "phone":
            p = (n(3), n(3), n(4))
            return kind, rnd.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+{}-{}-{}", "001 {} {} {}", "({}) {} {}", "+1 ({}) {}-{}"]).format(*p)
        if kind == "email":
            host = f"{name()}{rnd.choice(['', n(1)])}.{rnd.choice(['com', 'org', 'net', 'example.com'])}"
            return kind, f"{name()}{rnd.choice(['', '.' + n(2), '_' + name(), '.' + name(), n(2)])}{rnd.choice([' [at] ', '(at)', ' (at) ', '[at]', ' @ ', '@'])}{host}"
        if kind == "ip":
            return kind, ".".join(str(rnd.randint(1, 254)) for _ in range(4))
        c = card()
        return kind, rnd.choice(["", " ", "-", ".", "/"]).join(c[i : i + 4] for i in range(0, 16, 4))

    def lookalike() -> str:
        return rnd.choice([
            lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", lambda: f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/{rnd.randint(1900, 2030)}",
            lambda: f"{rnd.randint(1, 9)}.{rnd.randint(0, 20)}", lambda: f"{rnd.randint(0, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 99)}", lambda: n(rnd.randint(1, 12)),
            lambda: f"{rnd.randint(1, 999)},{n(3)},{n(3)}", lambda: f"#{n(8)}", lambda: f"{rnd.randint(1, 23)}:{n(2)}", lambda: f"password={name()}{n(6)}", lambda: f"AK{n(3)}{name().upper()}{n(2)}",
            lambda: f"@{name()}", lambda: f"({rnd.randint(1900, 2030)})", lambda: f"{n(3)}-{n(4)}", lambda: f"{n(4)}-{n(4)}", lambda: f"{n(2)} {n(3)} {n(2)}", lambda: f"{n(16)}{n(8)}",
            lambda: f"v{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}", lambda: f"{n(3)} {n(4)}", lambda: f"{n(4)}–{n(4)}", lambda: f"{n(8)}T{n(6)}Z", lambda: f"IMG{n(8)}{n(6)}", lambda: f"{name()}{name()}{name()}{n(2)}", lambda: f"pp. {n(3)}-{n(3)}", lambda: f"ISBN 978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", lambda: f"{n(10)}",
        ])()

    text, out = "", []
    for _ in range(rnd.randint(1, 2)):
        text += " ".join(rnd.choices(words, k=rnd.randint(1, 4))) + " "
        if (draw := rnd.random()) < 0.12:
            before, what = secret()
            text += before
            if mixed(what):
                out.append(("secret", len(text), len(text) + len(what)))
            text += what + ('"' if before.endswith('"') else "")
        elif draw < 0.55:
            kind, what = entity()
            out.append((kind, len(text), len(text) + len(what)))
            text += what
        else:
            text += lookalike()
        text += rnd.choice([" ", " ", ". ", ", "])
    return text + " ".join(rnd.choices(words, k=3)), out


def trained(sample: list[str], examples: int = 2500, steps: int = 150, seed: int = 5) -> SemiMarkov:
    """Weights that raise the likelihood of the true segmentations; forward and backward sums over all examples at once."""
    rnd = random.Random(seed)
    words = [w for t in sample for w in re.findall(r"[^\W\d_]+[.,]?", t)][:50_000] or ["some", "words", "here", "call", "write"]
    lines = [(*example(rnd, words), True) for _ in range(examples)]
    for t in sample:
        base = base_spans(t)
        lines += [(t[a:b], [(k, s - a, e - a) for k, s, e in base if s >= a and e <= b], False) for a, b in regions(t)]
    rows, start, stop, line, gold = [], [], [], [], []
    for n, (text, spans, told) in enumerate(lines[: 2 * examples]):
        known = {(s, e): KINDS.index(k) for k, s, e in spans}
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        for i, j, r in candidates(text, tokens, [False] * len(tokens), 0, len(tokens)):
            if not told and j == i + 1 and mixed(tokens[i][2]):
                continue  # of the sample's own text nobody says what is secret
            rows.append(r)
            start.append(i)
            stop.append(j)
            line.append(n)
            gold.append(known.get((tokens[i][0], tokens[j - 1][1]), -1))
    rows, start, stop, line, gold = map(np.array, (rows, start, stop, line, gold))
    weights, power = np.zeros((ROWS, len(KINDS))), np.full((ROWS, len(KINDS)), 1e-3)
    size, count = int(line.max()) + 1, int(stop.max()) + 1
    true = np.zeros((len(rows), len(KINDS)))
    true[gold >= 0, gold[gold >= 0]] = 1
    by_stop = [np.flatnonzero(stop == t) for t in range(count)]
    by_start = [np.flatnonzero(start == t) for t in range(count)]
    for _ in range(steps):
        score = weights[rows].sum(axis=1)
        segment = np.logaddexp.reduce(score, axis=1)
        ahead, behind = np.zeros((size, count + 1)), np.zeros((size, count + 1))
        for t in range(1, count):
            ahead[:, t] = ahead[:, t - 1]
            if len(x := by_stop[t]):
                np.logaddexp.at(ahead[:, t], line[x], ahead[line[x], start[x]] + segment[x])
        ahead[:, count] = ahead[:, count - 1]
        for t in range(count - 1, -1, -1):
            behind[:, t] = behind[:, t + 1]
            if len(x := by_start[t]):
                np.logaddexp.at(behind[:, t], line[x], behind[line[x], stop[x]] + segment[x])
        whole = ahead[line, start] + behind[line, stop] - ahead[line, count]
        off = true - np.exp(score + whole[:, None])
        grad = np.stack([np.bincount(rows.ravel(), np.repeat(off[:, k], rows.shape[1]), minlength=ROWS) for k in range(len(KINDS))], axis=1)
        grad -= 0.05 * weights
        power += grad**2
        weights += 0.5 * grad / np.sqrt(power)
    return SemiMarkov(weights.astype(np.float32))


def learned(docs: DataFrame) -> SemiMarkov:
    """A field trained with a hash-drawn, bounded sample of the documents."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_LONGEST))
    total = rows.count()
    drawn = rows.filter(hashed_unit("pii", F.col("id")) < min(1.0, SAMPLE_DOCS / max(total, 1))).orderBy("id").limit(2 * SAMPLE_DOCS)
    return trained([r["text"] for r in drawn.select("id", "text").collect()])


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all), n_added, n_spans of every row."""
    of = docs.sparkSession.sparkContext.broadcast(field or learned(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, digest, every, more, all_ = [[] for _ in BASE_KINDS], [], [], [], []
            for text in batch.column("_text"):
                base, spans = of.value.spans(text.as_py())
                for n, kind in enumerate(BASE_KINDS):
                    counts[n].append(sum(k == kind for k, _, _ in base))
                digest.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                every.append(written_out(spans))
                more.append(len(spans) - len(base))
                all_.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(more, pa.int64()), pa.array(all_, pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added", "n_spans"],
            )

    return docs.select(long_id(docs).alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )
