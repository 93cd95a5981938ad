"""The vector index: differential upsert and its statistics.

Plain Parquet has no MERGE: ``merge`` gives the next snapshot, in one shuffle by chunk_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from docspark.functions import text as X

# An index row's metadata.
TEXT_FIELDS = ["level", "parent_id", "prev_id", "next_id", "unit_type_start", "unit_type_end", "filename", "nature", "ext", "origin_path", "canonical_path", "modified_time", "tokenizer"]
NUMBER_FIELDS = ["token_count", "start_char", "end_char", "unit_index_start", "unit_index_end"]


def flatten(leaves: DataFrame, sources: DataFrame | None = None, model: str = "", strict: bool = True) -> DataFrame:
    """Leaf chunks as index rows: chunk_id, text, source_id, TEXT_FIELDS as strings, NUMBER_FIELDS as ints (0 if they are none), embedding_model.

    ``sources`` (source_id and fields of the registry) adds a document's fields. A leaf without an identifier or
    text is an error; with ``strict`` off such leaves are left out.
    """
    rows = leaves
    if sources is not None:
        rows = rows.join(sources.select("source_id", *[c for c in TEXT_FIELDS if c in sources.columns and c not in leaves.columns]), "source_id", "left")
    good = (F.trim(F.coalesce("chunk_id", F.lit(""))) != "") & (X.strip(F.coalesce("text", F.lit(""))) != "")
    chunk_id = F.trim("chunk_id")
    if strict:
        chunk_id = F.when(good, chunk_id).otherwise(F.raise_error(F.concat(F.lit("leaf without chunk_id or text: "), F.coalesce("chunk_id", F.lit("")))))
    else:
        rows = rows.where(good)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("leaf" if c == "level" else "")) if c in rows.columns else F.lit("leaf" if c == "level" else "")
    number = lambda c: X.to_int(F.col(c).cast("string")) if c in rows.columns else F.lit(0)
    return rows.select(chunk_id.alias("chunk_id"), "text", text("source_id").alias("source_id"), *[text(c).alias(c) for c in TEXT_FIELDS], *[number(c).alias(c) for c in NUMBER_FIELDS], F.lit(model).alias("embedding_model"))


def filter_values(index: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): the distinct values to filter by, blank ones left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return index.select(pairs).select("x.field", "x.value").where("trim(value) <> ''").distinct()


def batch_stats(batched: DataFrame, length: str, group: str = "source_id") -> DataFrame:
    """Of each batch: texts, avg_chars (6 digits), max_chars."""
    return batched.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg(length), 6).alias("avg_chars"), F.max(length).alias("max_chars"))


def last_wins(rows: DataFrame, order: str, key: str = "chunk_id") -> DataFrame:
    return rows.withColumn("_w", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_w = 1").drop("_w")


def diff(existing: DataFrame, desired: DataFrame, everything: bool = False) -> DataFrame:
    """(chunk_id, source_id, action): embed, keep or delete; with ``everything`` known chunks are embedded again."""
    old = existing.select("chunk_id", F.col("source_id").alias("old_source"), F.lit(True).alias("old"))
    new = desired.select("chunk_id", F.col("source_id").alias("new_source"), F.lit(True).alias("new"))
    both = old.join(new, "chunk_id", "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | F.lit(everything), "embed").otherwise("keep")
    return both.select("chunk_id", F.coalesce("new_source", "old_source").alias("source_id"), action.alias("action"))


def upsert_stats(actions: DataFrame) -> DataFrame:
    """A row per source: total, newly_embedded, unchanged, stale_deleted."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.groupBy("source_id").agg(n("embed", "keep").alias("total"), n("embed").alias("newly_embedded"), n("keep").alias("unchanged"), n("delete").alias("stale_deleted"))


def merge(existing: DataFrame, desired: DataFrame, embedded: DataFrame) -> DataFrame:
    """The next snapshot: ``desired``'s rows (text, metadata), with new vectors where there are, else the old ones."""
    old = existing.select("chunk_id", F.col("embedding").alias("old_vector"))
    new = embedded.select("chunk_id", F.col("embedding").alias("new_vector"))
    rows = desired.join(new, "chunk_id", "left").join(old, "chunk_id", "left")
    return rows.withColumn("embedding", F.coalesce("new_vector", "old_vector")).drop("new_vector", "old_vector").where("embedding IS NOT NULL")


def active_only(index: DataFrame, active: DataFrame) -> DataFrame:
    """Vectors of sources that are no longer extracted and chunked go."""
    return index.join(active.select("source_id").distinct(), "source_id", "left_semi")


def batches(rows: DataFrame, size: int = 64, group: str = "source_id", order: str = "chunk_id") -> DataFrame:
    """Adds ``batch``: slices of ``size`` over each source's chunks in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))
