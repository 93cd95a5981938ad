"""Searches against brute force: sent to all tasks, by cells, and through an inverted file."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.operators import inverted_file, retrieval
from docspark.plans import queries

SF = "/root/testdata/sf0.1"


def vectors(spark, n=300):
    rng = np.random.default_rng(6)
    rows = [(f"c{i}", f"s{i % 5}", rng.normal(size=8).tolist()) for i in range(n)]
    rows += [("null", "s1", None), ("zero", "s1", [0.0] * 8), ("short", "s2", [1.0, 2.0]), ("empty", "s2", [])]
    rows += [(f"hot{i}", "s3", [1.0] + [0.0] * 7) for i in range(150)]  # a third of all rows in one place
    return rows, spark.createDataFrame(rows, "chunk_id string, source_id string, embedding array<float>").repartition(6)


def asked(spark, rows, n=40):
    questions = [(i, rows[i * 3][2]) for i in range(n)] + [(900, None), (901, [0.0] * 8), (902, [3.0, 1.0]), (903, [1.0] + [0.0] * 7)]
    return questions, spark.createDataFrame(questions, "qid int, query array<double>")


def brute(rows, questions, k):
    out = {}
    for qid, q in questions:
        found = []
        for key, _, v in rows:
            a, b = (np.array(x or [], np.float32 if x is v else float).astype(float) for x in (v, q))
            like = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if len(a) == len(b) > 0 and a @ a > 1e-12 and b @ b > 1e-12 else 0.0
            found.append((round(1 - like, 9), key))
        out[qid] = [key for _, key in sorted(found)[:k]]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["chunk_id"])
    return out


@pytest.mark.parametrize("cell_rows,block", [(10**6, 10**6), (40, 7), (10**6, 3)])
def test_by_cells_and_by_sending(spark, cell_rows, block):
    rows, index = vectors(spark)
    questions, table = asked(spark, rows)
    want = brute(rows, questions, 6)
    one = table.withColumn("cell", F.lit(0))
    assert listed(retrieval.search_cells(index.withColumn("cell", F.lit(0)), one, 6, cell_rows, block)) == want == listed(retrieval.knn(index, table, 6))


def test_many_questions_are_one_plan(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    rows, index = vectors(spark)
    questions, table = asked(spark, rows)
    found = retrieval.knn(index, table, 5, {"source_id": ["s1", "s3"]})
    assert listed(found) == brute([r for r in rows if r[1] in ("s1", "s3")], questions, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" in plan  # not a branch for each block


def test_what_is_shuffled_grows_with_the_index_not_its_square(spark, monkeypatch):
    """Twice the rows and twice the questions: at most about twice the rows dealt out and found."""
    counted = []

    def sizes(n):
        rows, index = vectors(spark, n)
        _, table = asked(spark, rows, n // 3)
        found = retrieval.search_cells(index.withColumn("cell", F.lit(0)), table.withColumn("cell", F.lit(0)), 3, cell_rows=20, block=4)
        found.collect()
        executed, out = found._jdf.queryExecution().executedPlan(), []
        nodes = [executed]
        while nodes:  # rows of all exchanges of the plan that ran
            node = nodes.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                nodes.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                nodes.append(node.plan())
            else:
                if name == "ShuffleExchangeExec":
                    out.append(node.metrics().apply("shuffleRecordsWritten").value())
                nodes += [node.children().apply(i) for i in range(node.children().size())]
        return sum(out)

    counted = [sizes(n) for n in (600, 1200)]
    assert counted[0] > 0 and counted[1] < 2.2 * counted[0], counted


def test_blocks_hold_no_more_questions_than_a_task_may(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_HELD", 5)
    monkeypatch.setattr(retrieval, "MOST_BLOCKS", 2)
    monkeypatch.setattr(retrieval, "MOST_PARTS", 2)
    rows, index = vectors(spark)
    questions, table = asked(spark, rows)
    assert listed(retrieval.search_cells(index.withColumn("cell", F.lit(0)), table.withColumn("cell", F.lit(0)), 6, 40, 3)) == brute(rows, questions, 6)


def test_nearest_holds_few_rows_a_question(monkeypatch):
    """Thousands of equal vectors and tiles of a few pairs: the first of them in order, and no more than 2k and a batch's are held."""
    monkeypatch.setattr(retrieval, "TILE", 700)
    rng = np.random.default_rng(3)
    questions = [*rng.normal(size=(30, 4)).tolist(), None, [0.0] * 4, [1.0, 0, 0, 0]]
    rows = [(f"c{i:05}", ([2.0, 0, 0, 0] if i % 3 else rng.normal(size=4).tolist())) for i in range(6000)]
    rows[5] = ("c00005", [float("nan")] * 4)
    near, k, most = retrieval.Nearest(questions, 5), 5, 0
    for a in rng.permutation(range(0, 6000, 200)).tolist():
        part = rows[a : a + 200]
        near.add(pa.array([v for _, v in part], pa.list_(pa.float64())), pa.table({"chunk_id": [c for c, _ in part]}))
        most = max(most, near.held)
    assert most <= 3 * k * len(questions)
    got = {}
    for r in near.result().to_pylist():
        got.setdefault(r["_q"], []).append(r["chunk_id"])
    want = brute([(c, "", v if np.isfinite(v).all() else [0.0] * 4) for c, v in rows], list(enumerate(questions)), k)
    assert got == want


def test_inverted_file_holds_every_row(spark, tmp_path):
    rows, index = vectors(spark)
    questions, table = asked(spark, rows)
    centroids = inverted_file.build(index, f"{tmp_path}/ivf")
    assert spark.read.parquet(f"{tmp_path}/ivf/rows").count() == len(rows) and 15 < len(centroids.vectors) < 25
    # looking into all cells is the exact search, but for questions without direction
    everything = listed(inverted_file.search(spark, f"{tmp_path}/ivf", table, 6, probed=len(centroids.vectors)))
    want = brute(rows, questions, 6)
    assert all(everything[q] == want[q] for q in want if q < 900 or q == 903)
    some = listed(inverted_file.search(spark, f"{tmp_path}/ivf", table, 6, {"source_id": ["s3"]}))
    assert set(some) >= {q for q, _ in questions if q < 900} and all(x.startswith("hot") or int(x[1:]) % 5 == 3 for found in some.values() for x in found)


def test_recall_of_the_inverted_file(spark):
    exact, near = (listed(q(spark, SF)) for q in (queries.knn, queries.knn_inverted_file))
    recall = np.mean([len({*near[q]} & {*exact[q]}) / len(exact[q]) for q in exact])
    print("recall", recall)
    assert len(exact) == 40 and recall >= 0.9, recall


def test_vectors_in_clusters_need_few_cells(spark, tmp_path):
    """The number of cells follows the data: of 64 clusters a search looks into a few, and finds nearly all."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(64, 16))
    rows = [(f"c{i}", (centers[i % 64] + 0.05 * rng.normal(size=16)).tolist()) for i in range(4000)]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    centroids = inverted_file.build(index, f"{tmp_path}/ivf")
    table = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 4000, 50)], "qid int, query array<double>")
    exact, near = listed(retrieval.knn(index, table, 10)), listed(inverted_file.search(spark, f"{tmp_path}/ivf", table, 10))
    assert centroids.probed < 8 and np.mean([len({*near[q]} & {*exact[q]}) / 10 for q in exact]) >= 0.9


def test_an_index_without_vectors(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "chunk_id string, embedding array<float>")
    inverted_file.build(none, f"{tmp_path}/ivf")
    table = spark.createDataFrame([(1, [1.0])], "qid int, query array<double>")
    assert listed(inverted_file.search(spark, f"{tmp_path}/ivf", table, 3)) == {1: ["a"]}
