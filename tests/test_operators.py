"""Operators against known pairs of input and output."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.config import Indexing, Retrieval, Window
from docspark.functions import text as X
from docspark.functions.vectors import cosine
from docspark.operators import answers, chunking, index, registry, retrieval
from docspark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    raw = "Line 1\r\n\r\nLine 2\x0bText with nbsps\x07.\n\n\nLine 3"
    assert one(spark, X.normalize(F.lit(raw))) == "Line 1\n\nLine 2\nText with nbsps .\n\nLine 3"


@pytest.mark.parametrize("raw", ["", "a b", " a", "a\u2003", "a\u00a0b", "a\r\nb", "a \nb", "a\n\tb", "a\n\n\n\nb", "a\x85", "\x1fa", "a\n", "a  b\nc", None])
def test_lines_are_normalized_alike(spark, raw):
    text = F.lit(raw).cast("string")
    assert one(spark, X.normalize_line(text)) == one(spark, X.normalize(text))


def test_units_and_offsets(spark):
    units = F.array(*[F.struct(F.lit("page").alias("unit_type"), F.lit(i).alias("unit_index"), F.lit(t).alias("text")) for i, t in enumerate(("First page text", "   ", "Third page text"))])
    out = one(spark, chunking.materialize_units(units))
    assert out["text"] == "First page text\n\nThird page text" and [(u["start_char"], u["end_char"]) for u in out["units"]] == [(0, 15), (17, 32)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1023, 1024, 1025, 40_000])
def test_running_sums_of_any_length(spark, n):
    got = one(spark, X.running_sums(F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, F.lit(n)), lambda x: x % 7)))
    assert got == list(itertools.accumulate(x % 7 for x in range(n)))


def test_token_spans_are_those_of_the_regex(spark):
    texts = ["", "   ", "a", "\u00a0 a\u2003b\n\n c ", "\U0001f600 x" * 700, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.token_spans(F.col("t")).alias("s")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["s"] is None if t is None else [(x["s"], x["e"]) for x in r["s"]] == [m.span() for m in re.finditer(r"\S+", t)]


def test_window_bounds():
    for bad in ((0, 20, 30, 5), (30, 20, 30, 5), (10, 20, 15, 5), (10, 20, 30, -1), (10, 20, 30, 20)):
        with pytest.raises(ValueError):
            Window("leaf", *bad)
    for bad in ({"mode": "x"}, {"top_k": -1}, {"neighbor_depth": -1}, {"max_parents": -1}, {"mmr_lambda": 2}):
        with pytest.raises(ValueError):
            Retrieval(**bad)
    with pytest.raises(ValueError):
        Indexing(batch_size=0)


def test_chunk_graph(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([("s", text, [("p", 1, 0, len(text))])], "source_id string, text string, units array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>")
    leaves, parents = chunking.build_chunks(docs)
    rows, tops = leaves.orderBy("start_char").collect(), {p["chunk_id"] for p in parents.collect()}
    assert len(rows) > 3 and all(r["parent_id"] in tops and r["text"] == text[r["start_char"] : r["end_char"]] for r in rows)
    assert [r["next_id"] for r in rows[:-1]] == [r["chunk_id"] for r in rows[1:]] and rows[0]["prev_id"] == "" == rows[-1]["next_id"]


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(v).cast("float") for v in x])
    assert [one(spark, cosine(a(*x), a(*y))) for x, y in (((1, 0), (1, 0)), ((1, 0), (0, 1)), ((0, 0), (1, 1)), ((1,), (1, 1)))] == [1.0, 0.0, 0.0, 0.0]


def test_filters():
    assert retrieval.parse_filters(["a=1", "a=2", "  b  =  3  "]) == {"a": ["1", "2"], "b": ["3"]}
    for bad in ("=v", "noeq"):
        with pytest.raises(ValueError):
            retrieval.parse_filters([bad])


def test_caps_and_redundancy(spark):
    rows = spark.createDataFrame([(1, "a", 1, "s1"), (1, "b", 2, "s1"), (1, "c", 3, "s2")], "qid int, chunk_id string, rank int, source_id string")
    ids = lambda df: [r["chunk_id"] for r in df.orderBy("rank").collect()]
    assert ids(retrieval.capped_top(rows, 1, 10)) == ["a", "c"] and ids(retrieval.capped_top(rows, 0, 2)) == ["a", "b"]
    assert ids(retrieval.soft_cap(rows, 1)) == ["a", "c", "b"]
    assert retrieval.redundancy(rows, 2).first()["redundancy"] == 1.0


def test_mmr():
    assert set(retrieval.mmr_order(np.array([1.0, 0]), np.array([[1, 0], [0.99, 0.01], [0, 1]]), 2, 0.2)) == {0, 2}


def test_neighbors(spark):
    store = spark.createDataFrame([("x", "", "c1"), ("c1", "x", "y"), ("y", "c1", "z"), ("z", "y", "")], "chunk_id string, prev_id string, next_id string")
    seeds = spark.createDataFrame([(1, "c1", 1, 1.0, "x", "y")], "qid int, chunk_id string, rank int, score double, prev_id string, next_id string")
    got = {r["chunk_id"]: (round(r["score"], 6), r["expanded_from"], r["expanded_depth"]) for r in retrieval.expand_neighbors(seeds, store, 2).collect()}
    assert got == {"c1": (1.0, None, None), "x": (0.95, "c1", 1), "y": (0.95, "c1", 1), "z": (0.85, "y", 2)}


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 100), (1, 2, 1)], "qid int, rank int, tokens int")
    assert [r["rank"] for r in retrieval.within_budget(rows, 5).collect()] == [1]


def test_answers(spark):
    context = spark.createDataFrame([(1, i, f"c{i}", "s", "seed") for i in (1, 2, 3)] + [(2, 1, "d", "s", "seed")], "qid int, rank int, chunk_id string, source_id string, origin string")
    rows = spark.createDataFrame([(1, "A [C3]  b [C9] , [C1]."), (2, "UNKNOWN"), (3, "x [C1]")], "qid int, answer string")
    got = {r["qid"]: r for r in answers.finish(rows, context).collect()}
    assert got[1]["answer"] == "A [C1] b, [C2]." and [(c["label"], c["chunk_id"]) for c in got[1]["citations"]] == [("C1", "c3"), ("C2", "c1")]
    assert got[2]["answer"] == got[3]["answer"] == answers.NO_SOURCE and got[2]["citations"] == [] and got[2]["used_chunks"] == [] and len(got[1]["used_chunks"]) == 3


def test_index_diff(spark):
    make = lambda *ids: spark.createDataFrame([(i, "s") for i in ids], "chunk_id string, source_id string")
    stats = index.upsert_stats(index.diff(make("c1", "stale"), make("c1", "c2"))).first()
    assert (stats["total"], stats["newly_embedded"], stats["unchanged"], stats["stale_deleted"]) == (2, 1, 1, 1)
    assert index.upsert_stats(index.diff(make("c1"), make("c1"), everything=True)).first()["newly_embedded"] == 1


def test_registry_cases(spark):
    known = registry.normalize_registry(spark.createDataFrame([("h1", "h1", "a", "1", "t", "EXTRACTED"), ("h2", "h2", "b", "1", "t", "EXTRACTED"), ("h3", "h3", "c", "1", "t", "NEW")], "source_id string, content_hash string, canonical_path string, size_bytes string, modified_time string, extraction_status string"))
    scan = spark.createDataFrame([("a", "h9", "2"), ("d", "h2", "1"), ("e", "h5", "1")], "canonical_path string, content_hash string, size_bytes string")
    scan = scan.withColumns({"filename": F.lit("f"), "nature": F.lit("n"), "ext": F.lit(".pdf"), "origin_path": F.lit("o"), "modified_time": F.lit("t"), "seen_at": F.lit("now"), "artifact_exists": F.lit(True)})
    got = {r["canonical_path"]: (r["content_hash"], r["extraction_status"]) for r in registry.reconcile(known, scan).collect()}
    assert got == {"a": ("h9", "NEW"), "d": ("h2", "EXTRACTED"), "c": ("h3", "MISSING"), "e": ("h5", "NEW")}


def test_sections_of_paragraphs():
    assert [u["unit_type"] for u in files.group_paragraphs([("a", False), ("b", False)])] == ["paragraph"] * 2
    assert [u["text"] for u in files.group_paragraphs([("a", False), ("H", True), ("b", False)])] == ["a", "H\nb"]


def test_streaming_ingest(spark, tmp_path):
    from docspark.streaming.ingest import current, ingest

    schema = "source_id string, text string, units array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>"
    for rows in ([("s0", "some words here", [])], [("s1", "other words", []), ("s2", "to go", [])], [("s0", "changed words", []), ("s2", " ", None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    leaves = {r["source_id"]: r["text"] for r in current(spark, str(tmp_path / "out")).where("level = 'leaf'").collect()}
    assert leaves == {"s0": "changed words", "s1": "other words"}
    assert {r["source_id"]: len(r["embedding"]) for r in current(spark, str(tmp_path / "out"), "vectors").collect()} == {"s0": 64, "s1": 64}


@pytest.mark.parametrize(("raw", "name"), [("page", "Page"), (" SLIDE ", "Slide"), ("section ", "section"), (None, "")])
def test_unit_name(spark, raw, name):
    assert one(spark, X.unit_name(F.lit(raw).cast("string"))) == name


@pytest.mark.parametrize(("label", "place"), [("C12", 12), (" C3 ", 3), ("C", 10_000), ("Cx", 10_000), ("7", 10_000), (None, 10_000)])
def test_label_order(spark, label, place):
    assert one(spark, X.label_order(F.lit(label).cast("string"))) == place


def test_token_spans_are_a_pass_by_batch(spark):
    """Spans go by the batch, not by growing arrays of each text; white space is that of Spark's regular expressions, and a text with a wide character has places by code point."""
    texts = ["a\x1cb\x1f c", "\x85x　y​z", "\U0001f600 \U0001f600 ", None, "", "w " * 600_000, "end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", "t", X.token_spans(F.col("t")).alias("s"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    cut = F.transform("s", lambda x: F.substring("t", x["s"] + 1, x["e"] - x["s"]))
    words = F.regexp_extract_all("t", F.lit(r"(?U)\S+"), F.lit(0))
    rows = df.where("i <> 5").select("i", (cut == words).alias("same")).orderBy("i").collect()
    assert [r["same"] for r in rows] == [True, True, True, None, True, True]
    last = df.select("i", F.size("s").alias("n"), F.try_element_at("s", F.lit(-1)).alias("x")).orderBy("i").collect()
    assert [(r["n"], r["x"] and tuple(r["x"])) for r in last if r["i"] in (0, 4, 5, 6)] == [(2, (5, 6)), (0, None), (600_000, (1_199_998, 1_199_999)), (1, (0, 3))]
