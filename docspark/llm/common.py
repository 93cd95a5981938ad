"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark import storage

#: The white space that the exact operators delete or split at.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Bins of a histogram that comes to the driver.
BINS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    everything runs on one machine (as in tests) a temporary folder takes its place.
    """
    path = storage.shared_dir(spark, label)
    for scope in _scopes:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what was written to the shared folder inside, but for the paths that are taken out of the list it gives."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        for path in paths:
            storage.delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows and bytes, so that a worker's memory doesn't follow the length of texts."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", 3000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        if conf.get(key, None) is None:  # where the user has not chosen
            conf.set(key, str(most))

    def released(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    if not any("." in c for c in df.columns):
        return df.mapInArrow(released, schema)
    # mapInArrow takes a dot in a name for a field's: places stand for names on the way
    names, kind = df.columns, schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def renamed(batches):
        for batch in released(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])

    places = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kind.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, places).toDF(*kind.names)


def _give_back() -> None:
    """A reused worker keeps what its last task freed; this returns it to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def add_by_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], pa.Array]], kind: T.DataType, name: str) -> DataFrame:
    """Adds column ``name`` of type ``kind``, computed from ``text_col`` by Arrow batch.

    ``make`` runs once in each Python worker task and returns the function from
    a string array to an array of ``kind``; all other columns pass untouched.
    """
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_batch = make()
        for batch in batches:
            out = per_batch(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return arrow_map(df, run, schema)


def _cut(rows: DataFrame, col: str, most: int) -> tuple[int, int] | None:
    """The least value of ``col`` (bigint, not null) such that at most ``most`` rows have it or more, and how many these are.

    The range of values is cut into BINS and the bin in which the limit is reached is cut
    again, until values are told apart: a few counting jobs, BINS numbers each to the driver. None if there are no rows.
    """
    low, high = rows.agg(F.min(col), F.max(col)).first()
    if low is None:
        return None
    above = 0
    while True:
        width = (high - low) // BINS + 1
        inside = rows.where(F.col(col).between(low, high))
        counts = inside.groupBy(F.expr(f"(`{col}` - {low}) div {width}").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
        for b in sorted(counts, key=lambda b: -b["at"]):
            if above + b["n"] > most:
                break
            above += b["n"]
        else:
            return low, above
        low, high = low + b["at"] * width, min(high, low + (b["at"] + 1) * width - 1)
        if low == high:
            return low + 1, above


def most_frequent(counted: DataFrame, count_col: str, most: int, key_col: str = "token") -> DataFrame:
    """The ``most`` rows of the highest counts, or all if they are fewer; of equal counts those of the higher hash of ``key_col``.

    Keys whose hash (32 bits) is the one at the limit too are left out together, so a row or
    two may be missing. Counts are cut by histograms: no sort, and no long list comes to the driver.
    """
    counted = materialize(counted, "counts")
    found = _cut(counted, count_col, most)
    if found is None:
        return counted
    least, taken = found
    top = F.col(count_col) >= F.lit(least)
    tie = free_name(counted, "tie")
    ties = counted.where(F.col(count_col) == F.lit(least - 1)).select(F.shiftrightunsigned(F.xxhash64(key_col), 32).alias(tie))
    if taken < most and (at := _cut(ties, tie, most - taken)):
        top |= (F.col(count_col) == F.lit(least - 1)) & (F.shiftrightunsigned(F.xxhash64(key_col), 32) >= F.lit(at[0]))
    return counted.where(top)


#: Keys with over one of so many of all rows are joined by a broadcast: by count they are fewer than that.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``groups`` on ``keys`` (nulls equal), in which no key makes a large task.

    ``groups`` has one row a key, with the number of ``rows`` that hold it in ``count_col``; ``total`` rows there are in all.
    Keys that over one in HOT_SHARE rows hold are at most HOT_SHARE; they are broadcast. The other rows are
    shuffled, where a key's share is small. Both sides are read twice, so they should be written tables.
    """
    named = {k: free_name(rows, f"__{k}") for k in keys}
    hot = F.col(f"`{count_col}`") * HOT_SHARE > F.lit(total)
    others = [F.col(f"`{c}`") for c in groups.columns if c not in keys]

    def joined(of_rows: DataFrame, of_groups: DataFrame, how: str) -> DataFrame:
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{named[k]}`")) for k in keys]
        return of_rows.join(of_groups, on, how).drop(*named.values())

    marked = groups.select(*[F.col(f"`{k}`").alias(named[k]) for k in keys], *others)
    hottest = F.broadcast(marked.where(hot))  # HOT_SHARE rows at most
    rest = joined(rows, hottest.select(*[F.col(f"`{x}`") for x in named.values()]), "left_anti")
    return joined(rows, hottest, "inner").unionByName(joined(rest, marked.where(~hot), "inner"))
