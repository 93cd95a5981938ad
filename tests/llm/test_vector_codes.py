import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from docspark.llm import queries, vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks' digest, in Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in sorted(kept, key=lambda r: r[:2])[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: [min(range(len(books[p])), key=lambda e: (away(c, books[p][e]), e)) for p, c in enumerate(cut(v))]
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v, _ in kept:
            for p, e in enumerate(nearest(v)):
                of[p, e].append(cut(v)[p])
        for (p, e), group in of.items():
            books[p][e] = [sum(x) // len(group) for x in zip(*group)]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        code = nearest(v)
        error = sum(away(c, books[p][e]) for p, (c, e) in enumerate(zip(cut(v), code)))
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[label]) for i, c, e, label in out), digest


def stored(spark, path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def awkward(scale=1.0, n=150):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 24)], (None, 0, 1, 2)[i % 4]) for i in range(3, n)]
    rows += [(0, None, 1), (1, [float("nan")] * 24, 1), (2, [float("inf")] + [0.0] * 23, 1), (500, [None] + [0.0] * 23, 1)]
    rows += [(600 + i, rows[7][1], 0) for i in range(40)] + [(700, [0.0] * 24, None), (700, [0.0] * 24, None), (701, [-0.0001] * 24, 3)]
    return rows


@pytest.mark.parametrize("scale", [1e-4, 1.0, 3000.0])
def test_against_brute_force(spark, tmp_path, scale):
    rows = awkward(scale)
    got = queries.op11_vector_codes(spark, stored(spark, tmp_path, rows)).collect()
    want, digest = brute(rows)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want and {r["codebooks_sha256"] for r in got} == {digest}


def test_fewer_vectors_than_entries_other_lengths_and_a_rest(spark, tmp_path):
    rows = [(i, [float(i * k) for k in range(11)], i) for i in range(5)] + [(9, [1.0], 0), (10, [], 0)]
    got = queries.op11_vector_codes(spark, stored(spark, tmp_path, rows)).collect()
    want, digest = brute([(i, v + [0.0] * 5, label) for i, v, label in rows[:5]])
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want and {r["codebooks_sha256"] for r in got} == {digest}


def test_errors_beyond_64_bits_are_null(spark, tmp_path):
    rows = [(i, [2.0**40 * (i % 3 - 1) * (k + i)] + [0.0] * 7, 1) for k, i in enumerate(range(40))]
    rows += [(99, [2.0**60] * 8, 1)]
    got = {r["vec_id"]: r for r in queries.op11_vector_codes(spark, stored(spark, tmp_path, rows, "double")).collect()}
    want, _ = brute(rows[:-1])
    assert 99 not in got and {i: e if e < 1 << 63 else None for i, _, e, _ in want} == {i: r["error"] for i, r in got.items()} and {i: c for i, c, _, _ in want} == {i: r["code"] for i, r in got.items()}


@pytest.mark.parametrize("size", [2, 500, 10**5, 10**9, 2**61])
def test_the_screen_holds_the_nearest_and_little_else(size):
    """Rounding of single precision never loses an entry, ties and near ties included."""
    rng = np.random.default_rng(size % 1000)
    x, books = rng.integers(-size, size + 1, (120, 8, 6)), rng.integers(-size, size + 1, (8, 16, 6))
    books[:, 9], books[:, 12] = books[:, 4], books[:, 2] + rng.integers(0, 2, (8, 6))
    x[:40] = books[:, 2] + rng.integers(0, 2, (40, 8, 6))
    exact = ((x.astype(object)[:, :, None] - books.astype(object)[None]) ** 2).sum(-1)
    least = exact.min(axis=2)
    may = vector_codes.screen(x, books).transpose(1, 0, 2)
    assert may[exact == least[:, :, None]].all() and may.mean() < 0.25
    assert (vector_codes.assign(x, books) == (exact == least[:, :, None]).argmax(axis=2)).all()


def test_other_columns_pass(spark):
    names = ["code", "error", "label_error", "__n", "__label", "part"]
    rows = [(i, [float(i % 3)] * 8, i % 2, *names) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, " + ", ".join(f"`{n}` string" for n in names))
    coded = vector_codes.add_label_error(vector_codes.encode(docs, vector_codes.fit(docs)), error="error_")
    assert coded.columns == [*docs.columns, "code_", "error_", "label_error_"] and coded.where("code = 'code' AND `__label` = '__label' AND error_ = 0").count() == 30
