"""Exact deduplication as a stateful stream.

Texts are equal when identical after all ASCII white space is deleted. A stream
keyed by the digest of that normalised text keeps, for each digest and without
expiry, the row that stays (most code points in the original text, then the
smallest identifier), the number of rows and the content's locator, in RocksDB
state backed by the shared folder. Rows arrive in a table with their normalised text;
the locator (run and row) names the content there. A later run with the same ``state_dir`` sees
only new rows and goes on from that state; a run that is repeated under its name
adds nothing. Digests that were hit more than once, by rows of any runs,
are then checked on full normalised bytes; should a digest hold different texts
(a SHA-256 collision), those rows are grouped by the bytes themselves.

Defined results: a null text counts as empty; a null identifier stays only where its
text has no row with an identifier and the same length; of rows that repeat an
identifier and a text one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import storage
from docspark.llm.common import free_name, shared_dir

#: Runs of hits whose digests are broadcast to filter the byte check; larger sets are checked by a shuffle of all texts.
BROADCAST_DIGESTS = 200_000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB of disk for each small store
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalized(text: Column) -> Column:
    """Null as empty, every character of [\\x20\\x09-\\x0D] deleted."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _stays() -> Column:
    """Of a group the row that stays: most code points, an identifier before none, the smaller identifier, the earlier row."""
    return F.max_by(F.struct("n_chars", "id", "locator"), F.struct("n_chars", F.col("id").isNotNull(), F.bitwise_not("id"), F.bitwise_not("row")))


def _rows(docs: DataFrame, id_col: str, text_col: str, run: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), normalized(text).alias("norm"), F.unhex(F.sha2(text, 256)).alias("raw"), F.length(text).alias("n_chars"), F.monotonically_increasing_id().alias("row"))
    return out.select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), "n_chars", F.concat_ws("#", F.lit(run), "row").alias("locator"), "row", "raw", "norm")


def _with_confs(spark: SparkSession, confs: dict[str, str], run):
    old = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_state(spark: SparkSession, arrivals: str, schema, state_dir: str) -> DataFrame:
    """Streams the digests under ``arrivals`` that are new into the keyed state; returns the state's table.

    One row for each digest: digest, keep (n_chars, key, id), n_rows, locator.
    """
    keyed = spark.readStream.schema(schema).parquet(arrivals).groupBy("digest").agg(_stays().alias("keep"), F.count(F.lit(1)).alias("n_rows"))

    def save(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure overwrites what it wrote
        batch.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={number}")

    def run() -> None:
        query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/stream").foreachBatch(save).trigger(availableNow=True).start()
        query.awaitTermination()

    _with_confs(spark, ROCKSDB, run)
    try:
        changes = spark.read.schema("digest binary, keep struct<n_chars:int,id:bigint,locator:string>, n_rows bigint, batch int").parquet(f"{state_dir}/changes")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest binary, keep struct<n_chars:int,id:bigint,locator:string>, n_rows bigint")
    # of the versions of a digest the last is the state
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n_rows"), "batch").alias("s")).select("digest", "s.keep", "s.n_rows")


def contents(spark: SparkSession, state_dir: str, locators: DataFrame) -> DataFrame:
    """(locator, norm): the normalised texts that ``locators`` (locator) name."""
    return spark.read.schema("locator string, norm string").parquet(f"{state_dir}/arrivals/*").join(locators, "locator", "left_semi")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, run: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` and of earlier runs on ``state_dir``: id, keep_id, group_size, kept, digest (hex), raw (the original text's digest), keep_locator (content of the row that stays).

    ``run`` names the run (a fresh name if none is given).
    """
    spark = docs.sparkSession
    state_dir, run = state_dir or shared_dir(spark, "dedup-state"), run or uuid.uuid4().hex
    arrivals = f"{state_dir}/arrivals"
    rows = _rows(docs, id_col, text_col, run)
    if not storage.exists(spark, f"{arrivals}/{run}/_SUCCESS"):  # else the run is repeated
        rows.write.mode("overwrite").parquet(f"{arrivals}/{run}")
    texts = spark.read.schema(rows.schema).parquet(f"{arrivals}/*")
    rows = texts.drop("norm")
    state = update_state(spark, f"{arrivals}/*", rows.schema, state_dir)
    state_path = shared_dir(spark, "dedup-table")
    state.write.parquet(state_path)
    state = spark.read.schema(state.schema).parquet(state_path)
    bad = collisions(texts, state.where("n_rows > 1"))
    out = _columns(rows.join(state, "digest"))
    if bad.isEmpty():
        return out
    # different texts under one digest: their rows are grouped by the bytes instead
    split = texts.join(bad, "digest", "left_semi")
    groups = split.groupBy("digest", "norm").agg(_stays().alias("keep"), F.count(F.lit(1)).alias("n_rows"))
    exact = _columns(split.join(groups, ["digest", "norm"]))
    return out.join(bad.select(F.lower(F.hex("digest")).alias("digest")), "digest", "left_anti").unionByName(exact)


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("keep.id").alias("keep_id"), F.col("n_rows").alias("group_size"), (F.col("locator") == F.col("keep.locator")).alias("kept"), "raw", F.lower(F.hex("digest")).alias("digest"), F.col("keep.locator").alias("keep_locator"))


def collisions(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests of ``hits`` under which the full normalised bytes of ``texts`` (digest, norm) differ (none, but for a SHA-256 collision)."""
    texts = texts.select("digest", "norm")
    if hits.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        texts = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi")  # at most 32 bytes times the bound
    return texts.distinct().groupBy("digest").count().where("count > 1").select("digest")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; rows that repeat identifier and text are one."""
    key, raw = free_name(docs, "__id"), free_name(docs, "__raw")
    found = deduplicate(docs, id_col, text_col, state_dir)
    stay_id, stay_raw = free_name(docs, "stay_id"), free_name(docs, "stay_raw")
    stay = found.where("kept").select(F.col("id").alias(stay_id), F.col("raw").alias(stay_raw))
    rows = docs.withColumn(key, F.col(f"`{id_col}`").cast("bigint")).withColumn(raw, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    rows = rows.join(stay, F.col(key).eqNullSafe(F.col(stay_id)) & (F.col(raw) == F.col(stay_raw)), "left_semi")
    return rows.dropDuplicates([key, raw]).select(*[F.col(f"`{c}`") for c in docs.columns])
