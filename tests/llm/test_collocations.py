import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import collocations, queries


def brute(rows, longest=3, least=10, absorbed=50, top=2000):
    counts = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault("und" if lang is None else lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts():
    rng = np.random.default_rng(8)
    words = ["a", "B", "c", "éa", "漢字", "new", "york", "city", "x y", "'", "$1"]
    rows = []
    for i in range(260):
        chosen = [words[k] for k in rng.integers(0, len(words), rng.integers(0, 40))]
        glue = [" ", "  ", "\t ", ". ", "\n", ",", " \x0b", "; "]
        rows.append((("en", "fr", None, "und", "")[i % 5], "".join(w + glue[k] for w, k in zip(chosen, rng.choice(8, len(chosen), p=[0.6, 0.05, 0.05, 0.1, 0.05, 0.05, 0.05, 0.05])))))
    rows += [("en", "New York City, new york city! New   York city")] * 30 + [("en", None), ("fr", ""), ("fr", " \t .\n"), (None, "one")]
    rows += [("de", "w" * 20_000 + " the end"), ("de", "the end " * 4000)]
    return rows


@pytest.mark.parametrize("longest,least,block,buckets", [(3, 10, 500_000, 4), (3, 10, 50, 3), (2, 4, 1000, 1), (5, 3, 1000, 7)])
def test_against_brute_force(spark, monkeypatch, longest, least, block, buckets):
    """In few and many blocks and buckets, and with the first ranking in many parts."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "RANKED", 20)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in texts()], "lang string, text string, phrase string, n int")
    got = sorted(map(tuple, collocations.collocations(docs.repartition(3), longest, least, top=3 if block == 50 else 25, buckets=buckets).collect()))
    assert got == brute(texts(), longest, least, top=3 if block == 50 else 25) and got


def test_query(spark, tmp_path):
    spark.createDataFrame(texts(), "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_collocations(spark, str(tmp_path)).collect())) == brute(texts())


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_001
    counts = spark.createDataFrame([("en", "p q", big), ("en", "p", big + 7), ("en", "q", 4 * big + 1)], "lang string, phrase string, n bigint")
    r = collocations._score(counts, 4).first()
    assert r["score"] == 1_000_000 * big * big // ((big + 7) * (4 * big + 1)) and (r["l"], r["r"]) == (big + 7, 4 * big + 1)


def test_buckets_spill_and_hold_whole_phrases(spark, monkeypatch):
    """Equal phrases of different tasks meet in one bucket, whatever their batch; a bucket may be larger than its memory."""
    monkeypatch.setattr(collocations, "MEMORY", "24MB")
    docs = spark.range(60_000).select(F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("every"), F.sha2((F.col("id") % 30_000).cast("string"), 256), F.lit("one")).alias("text"))
    counts = collocations.count_phrases(docs.repartition(3), least=2, buckets=1)
    assert counts.where("phrase IS NOT NULL").count() == 2 + 4 * 30_000 - 30_000 * 0 and counts.where("phrase = 'every'").first()["n"] == 60_000
    assert counts.where("phrase IS NULL").agg(F.sum("n")).first()[0] == 180_000
