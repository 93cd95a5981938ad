"""Commits: failures at each step, two writers, and tables in buckets against the whole."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docspark import buckets, storage


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.read_version(spark, path, "x int").count() == 0
    with pytest.raises(FileNotFoundError):
        storage.read_version(spark, path)
    storage.write_version(spark.range(3), path)
    for _ in range(6):  # from the version before
        storage.write_version(storage.read_version(spark, path).selectExpr("id + 1 AS id"), path, keep=2)
    assert ids(storage.read_version(spark, path)) == [6, 7, 8]
    assert sorted(x[:9] for x in os.listdir(path)) == ["v00000006", "v00000007"]
    assert storage.under("/a", "/a/b") and not any(storage.under("/a", x) for x in ("/a", "/ab", "/a/../b"))


def test_tables_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = storage.Commit(spark, root)
    first.write("a", spark.range(2))
    first.write("b", spark.range(2))
    first.publish()
    state = lambda: (ids(storage.read_version(spark, f"{root}/a")), ids(storage.read_version(spark, f"{root}/b")))
    # killed between two tables, and before the entry
    killed = storage.Commit(spark, root)
    killed.write("a", spark.range(9))
    assert state() == ([0, 1], [0, 1])
    killed.write("b", spark.range(9))
    assert state() == ([0, 1], [0, 1])
    # the store refuses to move the entry into place
    with monkeypatch.context() as m:
        m.setattr(os, "link", lambda *_: (_ for _ in ()).throw(PermissionError("refused")))
        with pytest.raises(PermissionError):
            killed.publish()
    assert state() == ([0, 1], [0, 1]) and not [x for x in os.listdir(f"{root}/_log") if not x.endswith((".json", ".crc"))]
    # the same commit goes through later, and a failed one's number is free
    assert killed.publish() == 2 and state() == (list(range(9)), list(range(9)))
    # a table that fails to be written
    broken = storage.Commit(spark, root)
    broken.write("a", spark.range(1))
    with pytest.raises(Exception, match="boom"):
        broken.write("b", spark.range(1).select(F.raise_error(F.lit("boom")).cast("bigint").alias("id")))
    assert state() == (list(range(9)), list(range(9)))


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path)
    storage.write_version(spark.range(1), f"{root}/a")
    one, two, three = (storage.Commit(spark, root) for _ in range(3))
    for commit, n in ((one, 5), (two, 6)):
        commit.read("a")
        commit.write("a", spark.range(n))
    three.write("other", spark.range(3))
    one.publish()
    with pytest.raises(storage.CommitConflict):
        two.publish()
    three.publish()  # another table: no conflict, and the first writer's table stays
    assert storage.read_version(spark, f"{root}/a").count() == 5 and storage.read_version(spark, f"{root}/other").count() == 3
    # a reader of what has changed may not build on it
    four, five = storage.Commit(spark, root), storage.Commit(spark, root)
    four.write("a", spark.range(1))
    five.write("c", five.read("a"))
    four.publish()
    with pytest.raises(storage.CommitConflict):
        five.publish()


@pytest.mark.parametrize("local", [True, False])
def test_an_entry_is_put_once(spark, tmp_path, monkeypatch, local):
    """By a hard link, and by the store's rename."""
    if not local:
        monkeypatch.setattr(os, "link", lambda a, b: None if storage._renamed(spark, *map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, (f"file://{a}", f"file://{b}"))) else (_ for _ in ()).throw(FileExistsError()))
    os.makedirs(f"{tmp_path}/log")
    place = f"{tmp_path}/log/1.json"
    assert storage.put_if_absent(spark, place, "mine") and not storage.put_if_absent(spark, place, "yours")
    assert storage.read_text(spark, place) == "mine" and [x for x in os.listdir(f"{tmp_path}/log") if not x.endswith(".crc")] == ["1.json"]


def test_a_lost_log_is_no_empty_table(spark, tmp_path):
    storage.write_version(spark.range(1), f"{tmp_path}/a")
    os.rename(f"{tmp_path}/_log", f"{tmp_path}/gone")
    with pytest.raises(RuntimeError, match="is gone"):
        storage.read_version(spark, f"{tmp_path}/a", "id bigint")


SCHEMA = "chunk_id string, source_id string, text string"


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_buckets_against_the_whole(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(buckets, "BROADCAST_KEYS", broadcast)
    rng, root, want = random.Random(3), str(tmp_path), {}
    read = lambda: {r["chunk_id"]: (r["source_id"], r["text"]) for r in storage.read_version(spark, f"{root}/index", SCHEMA).collect()}
    for step, (n_up, n_gone) in enumerate([(300, 0), (6, 4), (0, 5), (40, 3), (5, 0), (0, 0)]):
        source = lambda k: f"s{k % 40}"
        up = {f"c{k}": (source(k), f"text {step}") for k in rng.sample(range(400), n_up)}
        gone = {k: want[k][0] for k in rng.sample(sorted(want), min(n_gone, len(want)))} | {"stranger": "s1"}
        commit = storage.Commit(spark, root)
        before = commit.before.get("index")
        done = buckets.change(commit, "index", SCHEMA, spark.createDataFrame([(k, *v) for k, v in up.items()], SCHEMA), spark.createDataFrame(list(gone.items()), "chunk_id string, source_id string"), n=16)
        assert read() == want
        commit.publish()
        want = {k: v for k, v in want.items() if k not in gone} | up
        assert read() == want
        if step in (1, 2, 4):  # small changes: only what they touch is written, other buckets are the files they were
            after = storage.Tables(spark, root).state()[1]["index"]
            changed = {b for b in after["base"] if after["base"][b] != before["base"].get(b)}
            assert done["touched"] < 13 and len(changed) <= done["merged"] <= done["touched"] and len(after["deltas"]) > 0
    assert len(want) > 200
    # of some sources only: other buckets' files are not named in the plan
    commit = storage.Commit(spark, root)
    some = buckets.read(commit, "index", SCHEMA, spark.createDataFrame([("s1",), ("s2",)], "source_id string"))
    assert {r["chunk_id"] for r in some.collect()} == {k for k, (s, _) in want.items() if s in ("s1", "s2")}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in some.inputFiles()}) <= 2


def test_small_changes_cost_what_they_touch(spark, tmp_path):
    """A hundredth of the sources changes: bytes written follow it, and so do the buckets merged."""
    root = str(tmp_path)
    rows = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("s"), (F.col("id") % 1000).cast("string")).alias("source_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    none = spark.createDataFrame([], "chunk_id string, source_id string")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/index") for f in fs if f.endswith(".parquet"))
    first = storage.Commit(spark, root)
    buckets.change(first, "index", SCHEMA, rows, none)
    first.publish()
    small, before = rows.where("source_id IN ('s1', 's2', 's3', 's4', 's5', 's6', 's7', 's8', 's9', 's10')"), size()
    commit = storage.Commit(spark, root)
    done = buckets.change(commit, "index", SCHEMA, small.withColumn("text", F.lit("new")), none)
    commit.publish()
    assert done["touched"] <= 10 and done["merged"] == 0 and size() - before < 0.1 * before
    assert storage.read_version(spark, f"{root}/index").where("text = 'new'").count() == 200 and storage.read_version(spark, f"{root}/index").count() == 20_000
