"""Tables of keyed rows in hash buckets, changed by deltas.

A row lies in the bucket of its group's hash (an index's group is the source). A change writes a delta: the rows
that are new or replaced, and a mark for each key that goes, in the buckets of their groups; base files stay as
they are. Reading lays the last delta of a key over the base. A bucket whose deltas have grown beyond a share
of its base is merged, alone. So a change costs what it touches, not what the table holds.

In a commit's state such a table is {"buckets", "group", "key", "schema", "base": {bucket: folder}, "deltas":
[{"folder", "buckets"}], in order of time, "rows": {bucket: [rows of the base, rows of deltas]}}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.storage import Commit

BUCKETS = 64
#: A bucket is merged when its deltas have this share of its base's rows.
MERGE_SHARE = 0.25
#: Delta keys that are broadcast against the base; of more, both sides are shuffled.
BROADCAST_KEYS = 500_000
_SEQ, _GONE, _BUCKET = "_seq", "_gone", "_bucket"


def bucket_of(group: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(group.cast("string")), F.lit(n)).cast("int")


def rows(spark: SparkSession, root: str, value: dict, only: set[int] | None = None) -> DataFrame:
    """The table's rows, or those of the buckets ``only``: no file of another bucket is read."""
    wanted = lambda b: only is None or int(b) in only
    base = [f"{root}/{folder}" for b, folder in value["base"].items() if wanted(b)]
    old = spark.read.schema(value["schema"]).parquet(*base) if base else spark.createDataFrame([], value["schema"])
    parts = [(i, f"{root}/{d['folder']}/{_BUCKET}={b}") for i, d in enumerate(value["deltas"]) for b in d["buckets"] if wanted(b)]
    if not parts:
        return old
    schema, key = f"{value['schema']}, {_SEQ} bigint, {_GONE} boolean", value["key"]
    deltas = spark.read.schema(schema).parquet(*[p for _, p in parts])
    last = deltas.groupBy(key).agg(F.max_by(F.struct(*deltas.columns), _SEQ).alias("x")).select("x.*")
    n = sum(value["rows"][str(b)][1] for b in {b for d in value["deltas"] for b in d["buckets"] if wanted(b)})
    keys = deltas.select(key).distinct()
    kept = old.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, key, "left_anti")
    return kept.select(*old.columns).unionByName(last.where(~F.col(_GONE)).select(*old.columns))


def buckets_of(groups: DataFrame, group: str, n: int) -> set[int]:
    """The buckets of ``groups``: at most n numbers come to the driver."""
    return {r[0] for r in groups.select(bucket_of(F.col(group), n)).distinct().collect()}


def read(commit: Commit, name: str, schema: str, groups: DataFrame | None = None, group: str = "source_id") -> DataFrame:
    """The table's rows, of ``groups`` (group) only if they are given: then their buckets alone are read."""
    commit.seen.add(name)
    value = commit.before.get(name)
    if groups is None or not isinstance(value, dict):
        found = commit.read(name, schema)
    else:
        found = rows(commit.tables.spark, commit.tables.root, value, buckets_of(groups, group, value["buckets"]))
    return found if groups is None else found.join(groups.select(group).distinct(), group, "left_semi").select(*found.columns)


def _counts(spark: SparkSession, path: str) -> dict[int, int]:
    """Rows of each bucket that was written under ``path``; the number is in the folders' names."""
    return {r[_BUCKET]: r["count"] for r in spark.read.schema(f"{_BUCKET} int").parquet(path).groupBy(_BUCKET).count().collect()}


def _write_base(commit: Commit, name: str, found: DataFrame, group: str, n: int) -> dict[str, tuple[str, int]]:
    """(folder, rows) of each bucket of ``found``."""
    folder = commit.folder(name)
    path = f"{commit.tables.root}/{folder}"
    # rows of a bucket go to a few tasks, so that a bucket has few files and a large one no large task
    spread = F.pmod(F.xxhash64(*found.columns[:1]), F.lit(8))
    dealt = found.withColumn(_BUCKET, bucket_of(F.col(group), n)).repartition(F.col(_BUCKET), spread)
    dealt.write.partitionBy(_BUCKET).parquet(path)
    counts = _counts(commit.tables.spark, path)
    return {str(b): (f"{folder}/{_BUCKET}={b}", c) for b, c in counts.items()}


def change(commit: Commit, name: str, schema: str, upserts: DataFrame, deletes: DataFrame, key: str = "chunk_id", group: str = "source_id", n: int = BUCKETS, merge_share: float = MERGE_SHARE) -> dict:
    """Puts ``upserts`` (all columns of ``schema``; a key once) and takes out ``deletes`` (key, group) in the commit; gives {"touched", "merged"}: numbers of buckets.

    A key that is in both stays. A key whose group has changed must be deleted in the old group's bucket, which is done here
    only if ``deletes`` says so. A table that is still in one piece is dealt into buckets first.
    """
    spark, root = commit.tables.spark, commit.tables.root
    commit.seen.add(name)
    value = commit.changed.get(name, commit.before.get(name))
    columns = spark.createDataFrame([], schema).columns
    if not isinstance(value, dict):
        whole = commit.read(name, schema).select(*columns)
        base = _write_base(commit, name, whole, group, n)
        value = {"buckets": n, "group": group, "key": key, "schema": schema, "base": {b: f for b, (f, _) in base.items()}, "deltas": [], "rows": {b: [c, 0] for b, (_, c) in base.items()}}
    else:
        value = value | {"base": dict(value["base"]), "deltas": [dict(d) for d in value["deltas"]], "rows": {b: list(c) for b, c in value["rows"].items()}}
    n = value["buckets"]
    seq = commit.number + 1
    put = upserts.select(*columns).withColumns({_SEQ: F.lit(seq).cast("bigint") * 2 + 1, _GONE: F.lit(False)})
    gone = deletes.select(*[F.col(c) if c in (key, group) else F.lit(None).alias(c) for c in columns]).withColumns({_SEQ: F.lit(seq).cast("bigint") * 2, _GONE: F.lit(True)})
    folder = commit.folder(name)
    made = put.unionByName(gone).withColumn(_BUCKET, bucket_of(F.col(group), n))
    made.write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    counts = _counts(spark, f"{root}/{folder}")
    if counts:
        value["deltas"].append({"folder": folder, "buckets": sorted(counts)})
    for b, c in counts.items():
        value["rows"].setdefault(str(b), [0, 0])[1] += c
    full = {int(b) for b, (of_base, of_deltas) in value["rows"].items() if of_deltas > merge_share * of_base}
    if full:
        base = _write_base(commit, name, rows(spark, root, value, full), group, n)
        for b in map(str, full):
            value["base"].pop(b, None)
            value["rows"].pop(b, None)
        value["base"] |= {b: f for b, (f, _) in base.items()}
        value["rows"] |= {b: [c, 0] for b, (_, c) in base.items()}
        value["deltas"] = [d | {"buckets": left} for d in value["deltas"] if (left := [b for b in d["buckets"] if b not in full])]
    commit.changed[name] = value
    return {"touched": len(counts), "merged": len(full)}
