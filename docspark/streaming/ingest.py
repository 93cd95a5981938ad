"""Incremental ingest: new and changed documents are chunked, and embedded, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.config import Chunking, Indexing
from docspark.operators import index
from docspark.operators.chunking import chunk
from docspark.sources.connectors import Embedder, HashEmbedder, embed_texts


def ingest(spark: SparkSession, source: str, schema, folder: str, checkpoint: str, config: Chunking = Chunking(), indexing: Indexing = Indexing(), make: Callable[[], Embedder] = HashEmbedder) -> StreamingQuery:
    """Streams Parquet of (source_id, text, units) into ``folder`` until nothing new is left: which sources came, their chunks and their vectors, a folder a batch.

    A batch that is repeated after a failure overwrites its own folders. A source that comes again
    replaces what it had: ``current`` shows each source as of its last batch. Of rows of one source in a batch one counts.
    """

    def save(batch: DataFrame, number: int) -> None:
        docs = batch.dropDuplicates(["source_id"])
        docs.select("source_id").write.mode("overwrite").parquet(f"{folder}/sources/batch={number}")
        chunk(docs, config).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/chunks/batch={number}")
        leaves = spark.read.parquet(f"{folder}/chunks/batch={number}").where("level = 'leaf'") if not docs.isEmpty() else None
        if leaves is not None:
            rows = index.flatten(leaves, model=indexing.model)
            embed_texts(rows, make, batch_size=indexing.batch_size, max_retries=indexing.max_retries, base_delay=indexing.base_delay).write.mode("overwrite").parquet(f"{folder}/vectors/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, table: str = "chunks") -> DataFrame:
    """The ``table`` (chunks, or vectors) with each source as of the last batch that brought it."""
    last = spark.read.parquet(f"{folder}/sources").groupBy("source_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/{table}").join(last, ["source_id", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by tumbling window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
