"""Named files, JSON lines read in parts, and trees of hashes."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from docspark.sources import admin, files

NAMED = "path string, size_bytes string"


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


@pytest.mark.parametrize("share", [3, 1 << 28])
def test_only_named_files_are_opened(spark, tmp_path, monkeypatch, share):
    """In many tasks and in few; of files that have gone there is no row, and a name that is a pattern is a name."""
    monkeypatch.setattr(files, "SHARE", share)
    for i in range(20):
        put(tmp_path / "x" / f"f {i}[a]{{b}}*%20.txt", str(i).encode())
    opened = tmp_path / "opened"
    opened.mkdir()

    def opener(path):
        f = files.open_input(path)
        (opened / path.rsplit("/", 1)[1]).touch()
        return f

    wanted = [f"file:{tmp_path}/x/f {i}[a]{{b}}*%20.txt" for i in (1, 3, 5, 7, 9, 11, 13, 30, 31)]
    rows = spark.createDataFrame([(w, "2") for w in wanted * 2], NAMED)
    want = {w: hashlib.sha256(str(i).encode()).hexdigest() for w, i in zip(wanted, (1, 3, 5, 7, 9, 11, 13))}
    assert sorted(map(tuple, files.hash_files(rows, opener).collect())) == sorted(want.items())
    assert len(os.listdir(opened)) == 7
    units = files.extract_units(rows, {".txt": lambda content: [{"unit_type": "page", "unit_index": 1, "text": content.decode()}]}, opener)
    assert sorted(int(r["units"][0]["text"]) for r in units.collect()) == [1, 3, 5, 7, 9, 11, 13]
    none = spark.createDataFrame([], "path string")
    assert files.hash_files(none).count() == 0 == files.hash_files(rows.where(F.col("path").contains("f 30"))).count()


def test_what_cannot_be_read_stays_with_its_row(spark, tmp_path):
    (tmp_path / "folder.txt").mkdir()
    put(tmp_path / "a.txt", b"x")
    rows = spark.createDataFrame([(f"{tmp_path}/folder.txt",), (f"{tmp_path}/a.txt",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.extract_units(rows, {".txt": lambda content: []}).collect()}
    assert got["a.txt"] is None and got["folder.txt"].startswith("IsADirectoryError")


def test_a_file_over_two_gigabytes_is_hashed_in_blocks(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.pdf", "wb") as f:
        f.truncate(size)
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size, len(zeros)):
        want.update(zeros[: size - at])
    assert [tuple(r) for r in admin.manifest(spark, str(tmp_path)).collect()] == [("large.pdf", want.hexdigest())]


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_json_lines_are_read_in_parts_and_the_first_bad_one_is_named(spark, tmp_path, small_parts, end):
    lines = ["" if i % 11 == 3 else "[1]" if i % 13 == 5 else json.dumps({"a": i, "b": "é" * (i % 40)}, ensure_ascii=False) for i in range(400)]
    want = sorted(json.loads(x)["a"] for x in lines if x.startswith("{"))
    put(tmp_path / "good" / "x.jsonl", end.join(lines).encode())
    put(tmp_path / "good" / "empty.jsonl", b"")
    got = files.read_jsonl(spark, str(tmp_path / "good"), "a int, b string")
    assert got.rdd.getNumPartitions() > 5 and sorted(r["a"] for r in got.collect()) == want
    for bad in ([0], [399], [200, 201, 390], [37]):
        broken = ['{"a": ' if i in bad else x for i, x in enumerate(lines)]
        put(tmp_path / f"bad{bad[0]}" / "a.jsonl", end.join(lines).encode())
        put(tmp_path / f"bad{bad[0]}" / "b.jsonl", end.join(broken).encode())
        with pytest.raises(ValueError, match=rf"b\.jsonl:{bad[0] + 1}$"):
            files.read_jsonl(spark, str(tmp_path / f"bad{bad[0]}"), "a int")


def tree(rows, levels):
    """The tree of hashes by plain loops."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    below, out = {}, {}
    for path, digest in rows:
        below.setdefault(sha(path)[: levels[0]], []).append((path, digest or "", 1))
    for digits in (*levels[1:], 0, 0):
        nodes = {node: (sha(",".join(f"{a}={b}" for a, b, _ in sorted(x))), sum(n for *_, n in x)) for node, x in below.items()}
        out |= nodes
        below = {}
        for node, (digest, n) in nodes.items():
            below.setdefault(node[:digits], []).append((node, digest, n))
    return out


@pytest.mark.parametrize("levels", [(4, 2), (1,), (3, 2, 1)])
def test_tree_of_hashes(spark, levels):
    rows = [(f"dir/{i}", f"{i * 7:x}" if i % 50 else None) for i in range(300)]
    schema = "path string, sha256 string"
    before = spark.createDataFrame(rows, schema)
    assert {r["node"]: (r["sha256"], r["n"]) for r in admin.hash_tree(before, levels).collect()} == tree(rows, levels)
    now = dict(rows)
    del now["dir/5"], now["dir/299"]
    now |= {"dir/7": "other", "dir/50": "there now", "new": "x", "dir/8": None}
    after = spark.createDataFrame(list(now.items()), schema)
    want = {(p, dict(rows).get(p), now.get(p)) for p in {*dict(rows), *now} if dict(rows).get(p) != now.get(p)}
    assert set(map(tuple, admin.changed_files(before, after, levels=levels).collect())) == want
    assert set(map(tuple, admin.changed_files(before, after, admin.hash_tree(before, levels), levels).collect())) == want
    none = spark.createDataFrame([], schema)
    assert admin.hash_tree(none).count() == 0 == admin.changed_files(before, before).count() and admin.changed_files(none, after).count() == len([v for v in now.values() if v])
