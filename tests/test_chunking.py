"""The batch algorithms of chunking against one document at a time, by plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.config import Chunking, Window
from docspark.operators import chunking

UNITS = "source_id string, text string, units array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>"


def greedy(n, bounds, w):
    out, start = [], 0
    while start < n:
        if n - start <= w.max_tokens:
            if out and n - start < w.min_tokens:
                out[-1] = (out[-1][0], n)
            else:
                out.append((start, n))
            break
        ideal = start + w.target_tokens
        end = min((b for b in bounds if start + w.min_tokens <= b <= start + w.max_tokens), key=lambda b: (abs(b - ideal), b), default=ideal)
        out.append((start, end))
        start = max(end - w.overlap_tokens, start) if end - w.overlap_tokens > start else end
    return out


def test_windows_against_greedy_loop():
    rng = np.random.default_rng(1)
    w = Window("leaf", 10, 20, 30, 5)
    cases = [(int(n), sorted({int(b) for b in rng.integers(1, n, rng.integers(0, 12))} if n > 1 else [])) for n in rng.integers(0, 200, 80)] + [(0, []), (15, []), (50, []), (50, [18]), (50, [5, 45]), (9, []), (31, [10]), (0, [])]
    first = np.r_[0, np.cumsum([n for n, _ in cases])]
    bounds = np.array([b + f for (_, bs), f in zip(cases, first) for b in bs], np.int64)
    doc, start, end = chunking.windows(first, bounds, w)
    for i, (n, bs) in enumerate(cases):
        own = doc == i
        assert list(zip((start[own] - first[i]).tolist(), (end[own] - first[i]).tolist())) == greedy(n, bs, w), (n, bs)


def sanitized(units, text):
    n = len(text)
    kept = [(max(0, min(s, n)), max(0, min(e, n)), k, i) for k, i, s, e in units or [] if s is not None and e is not None]
    kept = sorted((u for u in kept if text[u[0] : u[1]].strip()), key=lambda u: u[:2])
    return kept if kept and all(a[1] <= b[0] for a, b in zip(kept, kept[1:])) else [(0, n, "document", 1)]


def brute(source, text, units, config):
    text = text or ""
    units, spans = sanitized(units, text), [m.span() for m in re.finditer(r"\S+", text)]
    bounds = sorted({b for u in units if 0 < (b := sum(e <= u[1] for _, e in spans)) < len(spans)})
    levels = {}
    for w in (config.leaf, config.parent):
        rows = []
        for s, e in greedy(len(spans), bounds, w):
            a, b = spans[s][0], spans[e - 1][1]
            one = next((u for u in units if u[1] > a), units[-1])
            two = next((u for u in reversed(units) if u[0] < b), units[0])
            key = hashlib.sha256(f"{source}:{w.level}:{a}:{b}:{hashlib.sha256(text[a:b].encode()).hexdigest()}".encode()).hexdigest()
            rows.append({"chunk_id": key, "source_id": source, "level": w.level, "text": text[a:b], "token_count": e - s, "start_char": a, "end_char": b, "unit_type_start": one[2], "unit_index_start": one[3], "unit_type_end": two[2], "unit_index_end": two[3], "prev_id": "", "next_id": "", "parent_id": "", "tokenizer": "whitespace"})
        if w.level == "leaf" and rows:
            rows = [r for r in rows if r["token_count"] >= config.min_leaf_tokens] or [max(rows, key=lambda r: r["token_count"])]
        for a, b in zip(rows, rows[1:]):
            a["next_id"], b["prev_id"] = b["chunk_id"], a["chunk_id"]
        levels[w.level] = rows
    parents = levels[config.parent.level]
    for leaf in levels["leaf"]:
        at = next((i for i, p in enumerate(parents) if p["end_char"] > leaf["start_char"]), len(parents) - 1)
        shared = lambda i: max(0, min(parents[i]["end_char"], leaf["end_char"]) - max(parents[i]["start_char"], leaf["start_char"]))
        leaf["parent_id"] = parents[max((i for i in (at, at + 1, at - 1) if 0 <= i < len(parents)), key=shared)]["chunk_id"]
    return levels["leaf"] + parents


def documents():
    rng, out = random.Random(5), []
    for i in range(60):
        lines = [" ".join(rng.choice(["a", "bb", "é漢", "\U0001f600x", "word"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 12))]
        text, units, at = "\n\n".join(lines), [], 0
        for k, line in enumerate(lines):
            units.append((rng.choice(["page", "slide", "p"]), k + 1, at, at + len(line)))
            at += len(line) + 2
        if i % 5 == 1:
            units = [(t, k, s - 3, e + 3) for t, k, s, e in units]  # they overlap
        if i % 5 == 2:
            units = units[:1] + [("p", 9, None, 4), ("p", 8, 10**6, 10**7), ("p", 7, 5, 2), ("p", 6, -9, -1)]
        rng.shuffle(units)
        out.append((f"s{i}", text, None if i % 5 == 3 else units))
    return [*out, ("empty", "", []), ("null", None, None), ("blank", " \n \t", [("p", 1, 0, 3)]), ("one", "word", None), ("long", " ".join(f"w{k}" for k in range(5000)), [("p", 1, 0, 100), ("p", 2, 100, 9000)]), ("s0", "repeated identifier here", None)]


def test_words_are_those_of_the_regex():
    every = "".join(f"a{chr(c)}" for c in [*range(0x3200), 0xFEFF, 0x1F600, 0x10FFFF] if not 0xD800 <= c < 0xE000)
    for text in ("", " ", "a", " a  b ", every, "\n\n", "x\u3000y\u2028z\x1c\x85"):
        assert list(zip(*(x.tolist() for x in chunking.word_places(text)))) == [m.span() for m in re.finditer(r"\S+", text)]


@pytest.mark.parametrize("least", [0, 7])
@pytest.mark.parametrize("chars", [1, 500, 10**7])
def test_chunks_against_brute_force(spark, monkeypatch, least, chars):
    """Texts one by one, in some batches and all together: the same chunks, with the units of both ends, neighbours and parents."""
    config = Chunking(Window("leaf", 3, 6, 9, 2), Window("parent", 8, 14, 20, 3), min_leaf_tokens=least)
    monkeypatch.setattr(chunking, "BATCH_CHARS", chars)
    docs = documents()
    got = [r.asDict() for r in chunking.chunk(spark.createDataFrame(docs, UNITS).coalesce(1), config).collect()]
    want = [r for d in docs for r in brute(*d, config)]
    key = lambda r: (r["source_id"], r["level"], r["start_char"], r["chunk_id"])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 300


def test_memory_of_a_worker_does_not_follow_its_rows(spark):
    """108 MB of texts in one partition: a worker holds some megabytes of them at a time."""
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").cast("string").alias("source_id"), F.repeat(F.lit("word number "), 1500).alias("text"), F.array().cast("array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>").alias("units"))

    def each(batch):
        with open("/proc/self/status") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))
        yield pa.RecordBatch.from_arrays([pa.array([len(batch.joined)], pa.int32()), pa.array([len(batch.sources)], pa.int32()), pa.array([kb], pa.int32())], ["chars", "texts", "kb"])

    rows = chunking._by_batch(docs, Chunking(), each, "chars int, texts int, kb int").collect()
    assert sum(r["texts"] for r in rows) == 6000
    assert max(r["chars"] for r in rows) <= chunking.BATCH_CHARS + 18_001
    kb = [r["kb"] for r in rows]
    print("MB", min(kb) // 1024, max(kb) // 1024)
    assert max(kb) < 190 * 1024, max(kb)
