"""The source registry: a scan reconciled with what is known, and state resets.

Set-based: a full outer join by path, then a join by content hash for what moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docspark.schemas import CHUNK_FIELDS, CHUNKED, EXTRACTED, EXTRACTION_FIELDS, FAILED, INDEX_FIELDS, INDEXED, MISSING, NEW, PENDING, REGISTRY_FIELDS
from docspark.storage import materialize


def normalize_registry(rows: DataFrame) -> DataFrame:
    """The 24 fields as strings, '' where absent."""
    return rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in REGISTRY_FIELDS])


def cleared(fields: list[str], when: Column) -> dict[str, Column]:
    return {f: F.when(when, F.lit("")).otherwise(F.col(f)) for f in fields}


def reconcile(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """``scan``: canonical_path, content_hash, filename, nature, ext, origin_path, size_bytes, modified_time, seen_at, artifact_exists.

    Paths that are known keep their rows, equal content or not. Of unknown paths with equal content the greatest
    stays: it takes the row of known content that has lost its path, else that of a smaller path, else it is new (a greater path with that content: it goes).
    Rows that share a path all stay and are matched by it; the content hash of a scanned file may be null where size and time are those of the registry.
    """
    facts = ["canonical_path", "filename", "nature", "ext", "origin_path", "size_bytes", "modified_time"]
    one = normalize_registry(registry)
    s = scan.select(*[F.col(c).alias(f"s_{c}") for c in scan.columns])
    # written once: all that follows reads parts of it
    by_path = materialize(one.join(s, F.col("canonical_path") == F.col("s_canonical_path"), "full_outer"), "registry-by-path")
    matched = by_path.where("canonical_path IS NOT NULL AND s_canonical_path IS NOT NULL").withColumn("_case", F.lit("path"))
    lost = by_path.where("s_canonical_path IS NULL").select(*REGISTRY_FIELDS)
    matched = matched.withColumn("s_content_hash", F.coalesce("s_content_hash", "content_hash"))
    fresh = by_path.where("canonical_path IS NULL").select(*s.columns)
    fresh = fresh.withColumn("_w", F.row_number().over(W.partitionBy("s_content_hash").orderBy(F.desc("s_canonical_path")))).where("_w = 1").drop("_w")
    # content that is still at a known path, and nowhere lost: the greater path has the row
    held = matched.groupBy("s_content_hash").agg(F.max("canonical_path").alias("_held")).join(lost.select(F.col("content_hash").alias("s_content_hash")).distinct(), "s_content_hash", "left_anti")
    fresh = fresh.join(held, "s_content_hash", "left").where("_held IS NULL OR _held < s_canonical_path")
    taken = fresh.where("_held IS NOT NULL").select(*s.columns, F.col("_held").alias("canonical_path"))
    fresh = fresh.where("_held IS NULL").select(*s.columns)
    repathed = matched.select(*REGISTRY_FIELDS).join(taken, "canonical_path").select(*REGISTRY_FIELDS, *s.columns).withColumn("_case", F.lit("hash"))
    matched = matched.join(taken.select("canonical_path"), "canonical_path", "left_anti").select(*REGISTRY_FIELDS, *s.columns, "_case")
    moved_to = lost.join(fresh, F.col("content_hash") == F.col("s_content_hash"), "left")
    moved_to = moved_to.withColumn("_m", F.row_number().over(W.partitionBy("content_hash").orderBy("source_id"))).withColumn("_hit", F.col("s_canonical_path").isNotNull() & (F.col("_m") == 1))
    moved = moved_to.where("_hit").drop("_m", "_hit").withColumn("_case", F.lit("hash"))
    gone = moved_to.where("NOT _hit").select(*REGISTRY_FIELDS, *[F.lit(None).cast(t).alias(c) for c, t in s.dtypes], F.lit("gone").alias("_case"))
    new = fresh.join(lost.select(F.col("content_hash").alias("s_content_hash")).distinct(), "s_content_hash", "left_anti").select(*[F.lit("").alias(f) for f in REGISTRY_FIELDS], *s.columns, F.lit("new").alias("_case"))
    rows = matched.unionByName(repathed).unionByName(moved).unionByName(gone).unionByName(new)
    case, status = F.col("_case"), F.col("extraction_status")
    touched = (F.col("size_bytes") != F.col("s_size_bytes").cast("string")) | (F.col("modified_time") != F.col("s_modified_time"))
    changed = (case == "path") & touched & (F.col("content_hash") != F.col("s_content_hash"))
    back = ((case == "path") & (status == MISSING)) | ((case == "hash") & status.isin("", MISSING))
    restored = back & F.coalesce(F.col("s_artifact_exists"), F.lit(False))
    renew = (case == "new") | changed | (back & ~restored) | ((case == "path") & touched & status.isin("", FAILED)) | ((case == "hash") & (status == FAILED))
    rows = rows.withColumn("_status", F.when(case == "gone", F.when(F.col("canonical_path") == "", status).otherwise(MISSING)).when(renew, NEW).when(restored, EXTRACTED).otherwise(status))
    rows = rows.withColumns({"source_id": F.when(changed | (case == "new"), F.col("s_content_hash")).otherwise(F.col("source_id")), "_hash": F.when(changed | (case == "new"), F.col("s_content_hash")).otherwise(F.col("content_hash")), "_renew": renew, "_restored": restored & ~changed})
    rows = rows.withColumns({f: F.when(case != "gone", F.coalesce(F.col(f"s_{f}").cast("string"), F.lit(""))).otherwise(F.col(f)) for f in facts} | {"last_seen_time": F.when(case != "gone", F.col("s_seen_at")).otherwise(F.col("last_seen_time"))})
    rows = rows.withColumns({"extraction_status": F.col("_status"), "content_hash": F.col("_hash")} | cleared(EXTRACTION_FIELDS, F.col("_renew")))
    rows = rows.withColumn("extraction_error", F.when(F.col("_restored") | (case == "gone"), F.lit("")).otherwise(F.col("extraction_error")))
    live = F.col("extraction_status") == EXTRACTED
    rows = rows.withColumns(cleared([*CHUNK_FIELDS, *INDEX_FIELDS], ~live | F.col("_restored")))
    rows = rows.withColumn("chunk_status", F.when(live & (F.col("chunk_status") == ""), PENDING).otherwise(F.col("chunk_status")))
    return rows.select(*REGISTRY_FIELDS)


def origin_of(converted: DataFrame, raw: DataFrame) -> DataFrame:
    """``converted`` (stem, ext) with origin: of the raw files of the stem the old format, else the same, else null."""
    old = F.when(F.col("ext") == ".docx", ".doc").when(F.col("ext") == ".pptx", ".ppt").otherwise(F.col("ext"))
    files = raw.select(F.col("stem").alias("r_stem"), F.col("ext").alias("r_ext"), F.col("path"))
    first = files.select("r_stem", "r_ext", F.col("path").alias("old_path"))
    rows = converted.withColumn("_old", old).join(first, (F.col("stem") == F.col("r_stem")) & (F.col("_old") == F.col("r_ext")), "left").drop("r_stem", "r_ext", "_old")
    return rows.join(files, (F.col("stem") == F.col("r_stem")) & (F.col("ext") == F.col("r_ext")), "left").drop("r_stem", "r_ext").withColumn("origin", F.coalesce("old_path", "path")).drop("old_path", "path")


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(status), F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def conversion_summary(results: DataFrame) -> DataFrame:
    """One row: OK, SKIP, FAIL and DRYRUN, zero where none."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("OK", "SKIP", "FAIL", "DRYRUN")])


def run_counts(rows: DataFrame, status: str, done: str) -> DataFrame:
    """One row: processed (``status`` is ``done``) and failed, of the sources that a run took."""
    return rows.agg(F.count_if(F.col(status) == done).alias("processed"), F.count_if(F.col(status) == FAILED).alias("failed"))


def chosen(rows: DataFrame, sources: list[str] | None, limit: int, order: str = "source_id") -> DataFrame:
    """Of ``rows`` those of ``sources`` (all if none are named), the first ``limit`` of them by ``order`` (0: all)."""
    named = sorted({x.strip() for x in sources or [] if x and x.strip()})
    rows = rows.where(F.col("source_id").isin(named)) if named else rows
    return rows.orderBy(order).limit(limit) if limit > 0 else rows


def extraction_targets(registry: DataFrame, again: bool = False) -> DataFrame:
    return registry.where(F.col("extraction_status").isin(NEW, *([EXTRACTED] if again else [])))


def chunk_targets(registry: DataFrame, have: DataFrame, config: str, force: bool = False, sources: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Sources to chunk: extracted, and not chunked, chunked by other settings, or without chunks. ``have``: source_id of sources whose chunks exist."""
    rows = registry.where((F.col("extraction_status") == EXTRACTED) & (F.col("source_id") != "")).join(have.select("source_id", F.lit(True).alias("_have")).distinct(), "source_id", "left")
    stale = (F.col("chunk_status") != CHUNKED) | (F.col("chunk_config_hash") != config) | F.col("_have").isNull()
    return chosen(rows.where(F.lit(force) | stale).drop("_have"), sources, limit)


def index_targets(registry: DataFrame, have: DataFrame, config: str, force: bool = False, sources: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Sources to index: chunked, and not indexed, indexed by other settings, of another number of chunks, or without leaves. ``have``: source_id of sources with leaf chunks."""
    rows = registry.where((F.col("extraction_status") == EXTRACTED) & (F.col("chunk_status") == CHUNKED)).join(have.select("source_id", F.lit(True).alias("_have")).distinct(), "source_id", "left")
    stale = F.col("_have").isNull() | (F.col("index_status") != INDEXED) | (F.col("index_config_hash") != config) | (F.col("indexed_chunks") != F.col("nb_chunks"))
    return chosen(rows.where(F.lit(force) | stale).drop("_have"), sources, limit)


def purge_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of sources that are extracted; those of others, and of sources that the registry lacks, go."""
    return chunks.join(registry.where(F.col("extraction_status") == EXTRACTED).select("source_id").distinct(), "source_id", "left_semi")


def orphan_sources(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_id) of chunks whose source the registry lacks."""
    return chunks.select("source_id").distinct().join(registry.select("source_id"), "source_id", "left_anti")


def stale_converted(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Converted ``files`` (path) that no legacy file of ``expected`` (path) leads to."""
    return files.join(expected.select("path").distinct(), "path", "left_anti")


def missing_artifacts(registry: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (source_id, ...) of sources that are missing, and of no other source's row."""
    gone = registry.where(F.col("extraction_status") == MISSING).select("source_id")
    return artifacts.join(gone, "source_id", "left_semi").join(registry.where(F.col("extraction_status") != MISSING).select("source_id"), "source_id", "left_anti")


def purge_missing(registry: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry without the extracted paths of missing sources, artifacts without theirs)."""
    rows = registry.withColumn("extracted_path", F.when(F.col("extraction_status") == MISSING, F.lit("")).otherwise(F.col("extracted_path")))
    return rows, artifacts.join(missing_artifacts(registry, artifacts).select("source_id"), "source_id", "left_anti")


def to_hash(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Of a ``listing`` (canonical_path, size_bytes, modified_time) the files whose content must be read: unknown paths, and those whose size or time differ."""
    seen = registry.where("canonical_path <> '' AND content_hash <> ''").select("canonical_path", F.col("size_bytes").alias("_size"), F.col("modified_time").alias("_time")).dropDuplicates(["canonical_path"])
    rows = listing.join(seen, "canonical_path", "left")
    same = F.col("size_bytes").cast("string").eqNullSafe(F.col("_size")) & F.col("modified_time").eqNullSafe(F.col("_time"))
    return rows.where(~same).select(listing.columns)
