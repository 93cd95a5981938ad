import re
from collections import defaultdict

import numpy as np
import pytest

from docspark.llm import common, quality_rules, queries

FOOT, RULE = "read our terms of use 2024", "subscribe to the letter now"


def brute(rows, most=30, share=0.5):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), x))).strip(" ")
    holders = defaultdict(set)
    for _, t, host in rows:
        for x in (t or "").split("\n"):
            if split(x):
                holders[host, norm(x)].add(t)
    out = []
    for i, t, host in rows:
        t = t or ""
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        places = defaultdict(list)
        for k in range(len(w) - 4):
            places[tuple(w[k : k + 5])].append(k)
        repeated = len({k + j for at in places.values() if len(at) > 1 for k in at for j in range(5)})
        removed = [x for x in lines if len(holders[host, norm(x)]) > most]
        left = len(w) - sum(len(split(x)) for x in removed)
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed, len(removed), left, not failed and left >= 10 and left >= share * len(w)))
    return out


def rows():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)] + ["é#", "漢*", "<b>", " ", "|"]
    text = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    out = []
    for i in range(120):
        lines = [text(int(n)) for n in rng.integers(1, 25, rng.integers(1, 5))]
        if i % 3:
            lines.insert(int(rng.integers(0, len(lines))), ("  " if i % 2 else "") + FOOT.upper().replace("2024", str(2000 + i)) + "\r")
        if i % 4 == 0:
            lines += [RULE] * 6
        out.append((i, "\n".join(lines), ("a", "b", None)[i % 3 if i < 90 else 0]))
    out += [(i, "just one text\n" + FOOT + "\nthat many rows hold as it is, no more and no less", "b") for i in range(200, 260)]  # copies are one document
    long = text(9000)
    out += [(300, None, "a"), (301, "", "a"), (302, " \n\t\n", None), (303, "a b c d e a b c d e f g h", "a"), (304, "a a a a a a a a a a a a", "a"), (305, long + "\n" + long, "c"), (306, "x " * 30_000, "c"), (307, "z" * 200_000, "c"), (7, "repeated identifier", "a"), (None, text(30), None)]
    return out


@pytest.mark.parametrize("most", [1, 10, 30])
@pytest.mark.parametrize("hot", [1, 1000])
def test_against_brute_force(spark, monkeypatch, most, hot):
    """Whether lines and texts are joined by a broadcast or a shuffle."""
    monkeypatch.setattr(common, "HOT_SHARE", hot)
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, source string").repartition(5)
    got = list(map(tuple, quality_rules.assess(docs, most=most).collect()))
    assert sorted(got, key=str) == sorted(brute(rows(), most), key=str)


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_quality_rules(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows()), key=str)
    assert not [line for line in got._jdf.queryExecution().toString().splitlines() if "Python" in line or "Arrow" in line]


def test_windows_whose_hashes_meet_are_compared(spark, monkeypatch):
    """With a hash that is always the same, all windows are suspects and the words themselves decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e g"), (2, "a b c d e f g h i j")], "id int, text string")
    got = docs.select("id", quality_rules.repeated_words(quality_rules.words_of(F.col("text"))).alias("n"))
    assert {r["id"]: r["n"] for r in got.collect()} == {1: 10, 2: 0}


def test_clean_removes_lines_and_keeps_columns(spark):
    names = ["rules", "__removed", "__host", "host", "content", "digest", "__n"]
    body = lambda i: f"alpha{i} beta gamma delta epsilon\nzeta eta theta{i} iota kappa lambda mu"
    data = [(i, body(i) + ("\n" + FOOT if i % 2 else "") + "\n\nend", "h", *names) for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = quality_rules.clean(docs)
    # alpha0 and alpha1 are one line in the form compared, so all of a body's lines are frequent
    assert got.columns == docs.columns and got.count() == 0
    data = [(i, "\n".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)} {w}" for w in ("one two three", "four five six", "seven eight nine ten eleven")) + f"\n{FOOT}\n\nend", "h", *names) for i in range(100)]
    got = {r["doc_id"]: r for r in quality_rules.clean(spark.createDataFrame(data, docs.schema)).collect()}
    assert len(got) == 100 and all(r["text"] == data[i][1].replace(f"\n{FOOT}", "").replace("\nend", "") and r["content"] == "content" for i, r in got.items())
