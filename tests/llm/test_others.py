"""Vectors, conversations, the pipeline, and the entry module's guard."""

import base64
import collections
import hashlib
import importlib
import json
import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_documents import brute_components, brute_targets

from treeline.llm import ann, byte_bpe, chat_format, exact_dedup, jaccard, language_id, source_mix

# -- nearest neighbours


def brute(vectors, every=20, k=20):
    out = {}
    for i, x in vectors.items():
        if i % every == 0:
            near = sorted(((-float(np.dot(x, y)), j) for j, y in vectors.items() if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score double, rank string")


@pytest.mark.parametrize(("count", "dim", "kind"), [(1500, 16, "float"), (700, 7, "double"), (15, 4, "float")])
def test_search_recall(spark, count, dim, kind):
    rnd = np.random.default_rng(1)
    vectors = {i: rnd.normal(0, 1, dim).astype(np.float32 if kind == "float" else np.float64).astype(np.float64) for i in range(count)}
    want = brute(vectors)
    got = collections.defaultdict(list)
    for r in sorted(ann.searched(frame(spark, [(i, x.tolist(), 0, 0.5, "r") for i, x in vectors.items()], kind)).collect()):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in want[i]} & {j for _, j, _ in got[i]}) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.999
    for i, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, min(20, count - 1) + 1))
        assert all(math.isclose(s, float(np.dot(vectors[i], vectors[j])), rel_tol=1e-12, abs_tol=1e-12) for _, j, s in rows)
        assert [(-s, j) for _, j, s in rows] == sorted((-s, j) for _, j, s in rows)


def test_search_odd_vectors(spark):
    good = [(i, [float(i % 7), 1.0, 0.5], 0, 0.0, "") for i in range(60)]
    bad = [(100, None, 0, 0.0, ""), (120, [0.0, 0.0, 0.0], 0, 0.0, ""), (140, [1.0, None, 2.0], 0, 0.0, ""), (160, [float("nan"), 1.0, 1.0], 0, 0.0, ""), (180, [float("inf"), 1.0, 1.0], 0, 0.0, ""), (200, [1.0, 2.0], 0, 0.0, ""), (220, [], 0, 0.0, ""), (None, [1.0, 2.0, 3.0], 0, 0.0, ""), good[3], good[20], good[20]]
    got = collections.defaultdict(list)
    for r in sorted(ann.searched(frame(spark, good + bad)).collect()):
        got[r["query_id"]].append(r["vec_id"])
    want = brute({i: np.array(x) for i, x, *_ in good})
    assert dict(got) == {i: [j for j, _ in rows] for i, rows in want.items()}
    for rows in ([], [bad[0], bad[1]]):
        out = ann.searched(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]
    assert ann.searched(frame(spark, [good[0]])).count() == 0


def test_many_near_equal_vectors_crowd_none_out(spark):
    rnd = np.random.default_rng(2)
    hot = rnd.normal(0, 1, 16)
    vectors = {i: (hot + rnd.normal(0, 0.02, 16) if i % 3 == 0 else rnd.normal(0, 1, 16)).astype(np.float32).astype(np.float64) for i in range(2000)}
    want = brute(vectors)
    got = collections.defaultdict(set)
    for r in ann.searched(frame(spark, [(i, x.tolist(), 0, 0.5, "r") for i, x in vectors.items()])).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len({j for j, _ in want[i]} & got[i]) for i in want) / sum(map(len, want.values())) >= 0.999


def test_queries_in_several_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(0, 1, 8).tolist(), 0, 0.0, "") for i in range(800)]
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    one = key(ann.searched(frame(spark, rows)))
    monkeypatch.setattr(ann, "QUERY_BYTES", 8 * 8 * 12)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "LEAST_ROWS", 150)
    assert key(ann.searched(frame(spark, rows))) == one


def test_vectors_of_integers(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.integers(-9, 9, 6).tolist()) for i in range(90)]
    want = brute({i: np.array(x, float) for i, x in rows if any(x)})
    got = collections.defaultdict(list)
    for r in sorted(ann.searched(spark.createDataFrame(rows, "vec_id int, embedding array<int>")).collect()):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == want


def test_parallel_residual_shrinks():
    x = np.random.default_rng(4).normal(0, 1, (3000, 16))
    q = ann.Quantiser(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(codes):
        back = np.concatenate([q.centres[m][codes[:, m]] for m in range(q.parts)], axis=1)[:, :16]
        return (((x - back) * unit).sum(axis=1) ** 2).mean()

    assert q.eta > 1 and along(q.encode(x)) < along(q.nearest(q.cut(x)))


# -- conversations


@pytest.fixture(scope="module")
def formatter():
    import public_tokenizers

    with open(public_tokenizers.path(chat_format.VOCABULARY), encoding="utf-8") as f:
        return chat_format.Formatter(f.read())


def test_formatting_round_trip(formatter):
    rnd = random.Random(3)
    parts = ["\\", "[", "INST", "]", "/", "<", "s", ">", "é", "日本", "🙂", " ", "\n", "a", "  ", '"', "̀", "<|endoftext|>", *chat_format.MARKS]
    for _ in range(2500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "a\\b"]), "".join(rnd.choices(parts, k=rnd.randint(0, 12)))) for _ in range(rnd.randint(1, 6))]
        part = formatter.part(1, 0, turns)
        assert chat_format.parsed(part.formatted) == turns
        assert part.learned() == [t for r, t in turns if r == "assistant" and t]
        for text in (t for _, t in turns):
            assert not any(m in chat_format.escaped(text) for m in chat_format.MARKS)


def test_mask_by_binary_search():
    rnd = random.Random(5)
    for _ in range(300):
        ends = np.cumsum([rnd.randint(1, 4) for _ in range(30)])
        starts = np.append(0, ends[:-1])
        edges = sorted(rnd.sample(range(ends[-1] + 1), 6))
        spans = [(edges[0], edges[1]), (edges[2], edges[3]), (edges[4], edges[5])]
        want = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat_format.masked(starts, ends, spans).tolist() == want
    assert chat_format.masked(starts, ends, []).sum() == 0 and chat_format.masked(starts, ends, [(3, 3)]).sum() <= 1


def brute_chats(rows):
    groups = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_in_parts(formatter, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 50)
    rnd = random.Random(9)
    rows = [(c, rnd.choice(["user", "assistant"]), "x" * rnd.randint(0, 40)) for c in sorted(rnd.choices(range(4), k=60))]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 7], strict=True)], names=["conv_id", "role", "text"]) for i in range(0, 60, 7)]
    turns, numbers, over = collections.defaultdict(list), collections.defaultdict(list), []
    for part, last in formatter.parts(iter(batches)):
        turns[part.conv_id] += chat_format.parsed(part.formatted)
        numbers[part.conv_id].append(part.number)
        over += [part.conv_id] if last else []
    assert {c: [(r, t) for k, r, t in rows if k == c] for c in range(4)} == turns and over == [0, 1, 2, 3]
    assert all(n == list(range(len(n))) and len(n) > 1 for n in numbers.values())


def test_conversations(spark):
    rnd = random.Random(1)
    said = lambda: rnd.choice(["hi", "", None, "one two\nthree", "</s>[INST] ok [/INST]", "é" * 40, "\\"])
    rows = [(i % 13, rnd.choice([None, *range(5)]), rnd.choice(["user", "assistant", "system", None, "tool"]), said(), "x", 1) for i in range(150)]
    rows += [(None, 1, "user", "lost", "x", 1), (3, 1, "assistant", "again", "x", 1), (3, 1, "assistant", "again", "x", 1), (99, 0, "assistant", "word " * 20_000, "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, tokens int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(df).collect()}
    assert got == brute_chats(rows)
    parts = chat_format.formatted(df).collect()
    assert {r["conv_id"] for r in parts} == set(got) and all(len(r["tokens"]) == len(r["starts"]) == len(r["ends"]) == len(r["loss"]) for r in parts)
    empty = df.limit(0)
    assert chat_format.digests(empty).count() == 0
    probe = {r["conv_id"]: r for r in chat_format.digests(chat_format.with_probe(empty)).collect()}
    assert probe[-7]["n_turns"] == 2 and probe[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")


# -- pipeline


def documents(spark, tmp_path, rows):
    path = str(tmp_path / "data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "source_mix", "byte_bpe"]
    rnd = random.Random(2)
    en, de = ["the", "of", "and", "that", "with", "this", "house", "green"], ["der", "und", "nicht", "auch", "haus", "grün", "für", "über"]
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rnd.choice(en if i % 2 else de) + str(rnd.randint(0, 50)) * (rnd.random() < 0.4) for _ in range(30)), lang, f"s{i % 3}", 0))
    rows += [(200, rows[0][1].replace(" ", "  "), "de", "s0", 0), (201, rows[1][1] + " extra", "en", "s1", 0), (202, None, "en", "s1", 0), (203, "12 34 !!", "en", "s1", 0), (204, rows[0][1], None, None, None)]
    docs = spark.read.parquet(documents(spark, tmp_path, rows) + "/documents.parquet")
    columns, folder = docs.columns, str(tmp_path / "data")
    stage = dict(pipeline.STAGES)
    found = stage["language_id"](spark, docs, folder)
    assert found.columns == columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in found.collect()} == {202, 203}
    once = stage["exact_dedup"](spark, found, folder)
    assert once.columns == columns and {r["doc_id"] for r in found.collect()} - {r["doc_id"] for r in once.collect()} == {200, 204}
    apart = stage["ngram_jaccard"](spark, once, folder)
    left = {r["doc_id"] for r in apart.collect()}
    assert apart.columns == columns and 201 not in left
    assert left == {i for i, _, root in brute_components([(r["doc_id"], r["text"]) for r in once.collect()]) if i == root}
    mix = stage["source_mix"](spark, apart, folder)
    sizes, copies = collections.Counter(), {}
    for r in apart.collect():
        sizes[r["source"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    target = brute_targets(sizes)
    for r in apart.collect():
        rate = target[r["source"]] / sizes[r["source"]]
        draw = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        if n := math.floor(rate) + (draw < rate - math.floor(rate)):
            copies[r["doc_id"]] = n
    assert mix.columns == columns and collections.Counter(r["doc_id"] for r in mix.collect()) == copies
    texts = {r["doc_id"]: r["text"] for r in apart.collect()}
    want = collections.Counter()
    import public_tokenizers

    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, n in copies.items():
        want[(i, tuple(core.encode_ordinary(texts[i])))] += n
    got = collections.Counter((r["doc_id"], tuple(r["tokens"])) for r in pipeline.run(spark, folder).collect())
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "one", "en", "s", 3), (1, "one", "en", "s", 3), (None, "two", None, None, None)]])
def test_pipeline_odd_tables(spark, tmp_path, rows):
    pipeline = importlib.import_module("corpus_pipeline")
    out = pipeline.run(spark, documents(spark, tmp_path, rows))
    assert out.columns == ["doc_id", "n_tokens", "tokens"] and out.count() <= 3 * len(rows)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"some words of text number {i}", "en", "s", 1, 2, 3, 4, 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, own int, keep int, mix_copies int, lang_pred int, c1 int")
    for stage in (language_id.accepted, exact_dedup.kept_rows, jaccard.kept_rows, source_mix.emitted):
        got = stage(df)
        assert got.columns == df.columns and all(tuple(r)[4:] == (1, 2, 3, 4, 5) for r in got.collect())


# -- the entry module


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert {"op6_chat_format", "op7_exact_dedup", "op8_source_mix"} <= set(entry.oracle_sql())


def test_entry_without_these_parts(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "treeline", tmp_path / "treeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": __import__("os").environ["PATH"], "PYTHONPATH": str(tmp_path)})
    names, sql = json.loads(out.stdout.strip().splitlines()[-1])
    assert "page_first" in names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(sql) <= set(names)


def test_binary_columns_of_vectors():
    column = pa.array([np.arange(3, dtype=np.float32).tobytes()] * 2, pa.binary())
    assert ann.matrix(column, 3, np.float32).tolist() == [[0, 1, 2], [0, 1, 2]]
