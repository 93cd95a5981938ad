"""The update run: convert, scan and extract, chunk, index, each over what has changed since the last run.

State is the registry: a table of sources and their statuses. Every step reads the tables of the step
before, works on its targets as one DataFrame job, and commits its table and the registry together; a step that is lost halfway
leaves the state before. The index is in buckets (``buckets``), so a step writes what has changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docspark import buckets
from docspark.config import Chunking, Indexing, config_hash
from docspark.functions import text as X
from docspark.operators import chunking, index, registry as R
from docspark.schemas import CHUNK_FIELDS, CHUNKED, EXTRACTED, FAILED, INDEX_FIELDS, INDEXED, MISSING, NEW, PENDING, REGISTRY, REGISTRY_FIELDS
from docspark.sources import files
from docspark.sources.connectors import Embedder, HashEmbedder, embed_once, embed_texts
from docspark.storage import Commit, Layout, exists, materialize

EXTRACTED_SCHEMA = "source_id string, text string, units array<struct<unit_type:string,unit_index:int,text:string,start_char:int,end_char:int>>, stats struct<unit_count:int,char_count:int>, meta struct<source_id:string,origin_path:string,canonical_path:string,filename:string,nature:string,ext:string,modified_time:string>"
INDEX_SCHEMA = "chunk_id string, text string, source_id string, " + ", ".join([f"{c} string" for c in index.TEXT_FIELDS] + [f"{c} int" for c in index.NUMBER_FIELDS]) + ", embedding_model string, embedding array<float>"


@dataclass(frozen=True)
class Convert:
    enabled: bool = False
    raw: str = ""
    dry_run: bool = False
    force: bool = False
    keep_stale: bool = False
    limit: int = 0
    timeout: int = 180


@dataclass(frozen=True)
class Scan:
    enabled: bool = True
    roots: tuple[str, ...] = ()
    #: The folder of a corpus whose first level names the documents' nature, and the folder that stands for it wherever it is.
    nature_root: str = ""
    nature_marker: str = ""
    #: Converted files, which are scanned too, and the folder that they were made from.
    converted: str = ""
    raw: str = ""
    scan_only: bool = False
    keep_missing: bool = False
    again: bool = False
    extensions: tuple[str, ...] = files.SUPPORTED
    readers: dict[str, Callable] = field(default_factory=lambda: files.READERS)


@dataclass(frozen=True)
class Chunk:
    enabled: bool = True
    force: bool = False
    sources: tuple[str, ...] = ()
    limit: int = 0
    keep_stale: bool = False
    config: Chunking = Chunking()


@dataclass(frozen=True)
class Index:
    enabled: bool = True
    force: bool = False
    sources: tuple[str, ...] = ()
    limit: int = 0
    keep_stale: bool = False
    config: Indexing = Indexing()
    make: Callable[[], Embedder] = HashEmbedder
    #: Where embeddings are kept by text, so that none is paid for twice; by default they are not.
    ledger: str = ""


STATUSES = ("", NEW, EXTRACTED, FAILED, MISSING, PENDING, CHUNKED, INDEXED)
# Fixed value: what a registry row says of a file that was there when it was listed, and not when it was read.
GONE = "canonical_path missing on disk"


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def apply(registry: DataFrame, results: DataFrame, values: dict[str, Column], seen: Observation | None = None, status: str = "", done: str = "") -> DataFrame:
    """``registry`` with the fields of ``values`` (over ``results``'s columns, all but source_id named apart) set where a source has a result.

    ``seen`` counts the results on their way into the table: processed, whose ``status`` is ``done`` now, and failed.
    """
    rows = registry.join(results.withColumn("_done", F.lit(True)), "source_id", "left")
    rows = rows.withColumns({f: F.when(F.col("_done"), v).otherwise(F.col(f)) for f, v in values.items()})
    if seen is not None:
        rows = rows.observe(seen, *[F.count_if(F.col("_done") & (F.col(status) == s)).alias(name) for name, s in (("processed", done), ("failed", FAILED))])
    return rows.select(*REGISTRY_FIELDS)


def _blank(fields: list[str]) -> dict[str, Column]:
    return dict.fromkeys(fields, F.lit(""))


def _registry(commit: Commit) -> DataFrame:
    return R.normalize_registry(commit.read("registry", REGISTRY))


def _publish(commit: Commit, rows: DataFrame, status: str) -> dict[str, int]:
    """The step's tables and the registry become current together; gives the registry's rows by ``status``, counted while they are written."""
    seen, value = Observation(), F.coalesce(F.col(status), F.lit(""))
    rows = R.normalize_registry(rows).observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(value == s).alias(f"is_{s}") for s in STATUSES])
    commit.write("registry", rows)
    found = seen.get
    commit.publish()
    if found["rows"] > sum(found[f"is_{s}"] for s in STATUSES):  # a status that only a registry of other hands has
        return {r["status"]: r["n"] for r in R.status_counts(_registry(Commit(rows.sparkSession, commit.tables.root)), status).collect()}
    return {s: found[f"is_{s}"] for s in STATUSES if found[f"is_{s}"]}


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def with_origins(scan: DataFrame, step: Scan) -> DataFrame:
    """``scan`` (canonical_path, ext, ...) with origin_path: of a converted file the raw file that it came from, '' if that is gone; of any other file itself."""
    if not step.converted:
        return scan.withColumn("origin_path", F.col("canonical_path"))
    inside = lambda path, root: _plain(path).startswith(root.rstrip("/") + "/")
    stem = lambda path, root: F.regexp_replace(F.substring(_plain(path), len(root.rstrip("/")) + 2, 1 << 30), r"\.[^./]+$", "")
    made, raw = (path.removeprefix("file://") for path in (step.converted, step.raw))
    there = files.list_files(scan.sparkSession, [step.raw], (*step.extensions, *files.LEGACY)) if step.raw else scan.limit(0).withColumnRenamed("canonical_path", "path")
    converted = scan.where(inside(F.col("canonical_path"), made))
    origins = R.origin_of(converted.select("canonical_path", stem(F.col("canonical_path"), made).alias("stem"), "ext"), there.select(stem(F.col("path"), raw).alias("stem"), "ext", "path"))
    rows = scan.join(origins.select("canonical_path", "origin").dropDuplicates(["canonical_path"]), "canonical_path", "left")
    return rows.withColumn("origin_path", F.when(inside(F.col("canonical_path"), made), F.coalesce("origin", F.lit(""))).otherwise(F.col("canonical_path"))).drop("origin")


def scan_and_extract(spark: SparkSession, layout: Layout, step: Scan) -> dict:
    commit = Commit(spark, layout.root)
    known = _registry(commit)
    records = commit.read("extracted", EXTRACTED_SCHEMA)
    roots = [*([step.converted] if step.converted and exists(spark, step.converted) else []), *step.roots]
    scan = with_origins(files.scan_corpus(spark, roots, known, step.extensions), step)
    named = F.when(F.col("origin_path") != "", F.col("origin_path")).otherwise(F.col("canonical_path"))
    nature = X.nature_of(named, step.nature_root, step.nature_marker) if step.nature_root else F.lit("")
    artifacts = records.select(F.col("source_id").alias("content_hash"), F.lit(True).alias("artifact_exists")).distinct()
    scan = scan.join(artifacts, "content_hash", "left").withColumns({"nature": nature, "seen_at": _now(), "artifact_exists": F.coalesce("artifact_exists", F.lit(False))})
    rows = materialize(R.reconcile(known, scan), "registry")
    if not step.scan_only:
        targets = R.extraction_targets(rows, step.again).dropDuplicates(["source_id"])
        units = files.extract_units(targets.select(F.col("canonical_path").alias("path"), "size_bytes"), step.readers)
        found = targets.join(units.withColumnRenamed("path", "canonical_path"), "canonical_path", "left").withColumn("error", F.when(F.col("units").isNull() & F.col("error").isNull(), GONE).otherwise(F.col("error")))
        made = materialize(files.extracted_records(found.withColumn("units", F.coalesce("units", F.array()))), "extracted")
        good = made.where("error IS NULL").drop("error")
        records = records.join(good.select("source_id"), "source_id", "left_anti").unionByName(good)
        ok = F.col("_error").isNull()
        pending = {f: F.lit(PENDING if f == "chunk_status" else "") for f in CHUNK_FIELDS}
        rows = apply(rows, made.select("source_id", F.col("error").alias("_error")), {"extraction_status": F.when(ok, EXTRACTED).when(F.col("_error") == GONE, MISSING).otherwise(FAILED), "extraction_error": F.coalesce("_error", F.lit("")), "extracted_path": F.when(ok, F.lit(layout.extracted)).otherwise(""), "last_extracted_time": F.when(ok, _now()).otherwise("")} | {f: F.when(ok, v).otherwise("") for f, v in (pending | _blank(INDEX_FIELDS)).items()})
        rows = materialize(rows, "registry")
    purged = 0
    if not step.keep_missing:
        purged = R.missing_artifacts(rows, records).count()
        rows, records = R.purge_missing(rows, records)
    commit.write("extracted", records)
    return {"extraction_status_counts": _publish(commit, rows, "extraction_status"), "purged": purged, "scan_only": step.scan_only}


def run_chunking(spark: SparkSession, layout: Layout, step: Chunk) -> dict:
    commit = Commit(spark, layout.root)
    rows, old = _registry(commit), commit.read("chunks", chunking.CHUNK)
    settings = config_hash(step.config)
    kept = old if step.keep_stale else R.purge_chunks(old, rows)
    levels = old.groupBy("source_id").agg(F.count_distinct("level").alias("n")).where("n = 2")
    targets = materialize(R.chunk_targets(rows, levels, settings, step.force, list(step.sources), step.limit).select("source_id").distinct(), "targets")
    docs = commit.read("extracted", EXTRACTED_SCHEMA).join(targets, "source_id")
    new = materialize(chunking.chunk(docs.select("source_id", "text", "units"), step.config), "chunks")
    leaves = new.where("level = 'leaf'").groupBy("source_id").agg(F.count(F.lit(1)).cast("string").alias("_leaves"))
    reason = F.when(F.col("_there").isNull(), "extracted record not found").when(F.col("_leaves").isNull(), "no leaf chunks")
    results = targets.join(leaves, "source_id", "left").join(docs.select("source_id", F.lit(True).alias("_there")).distinct(), "source_id", "left").select("source_id", "_leaves", reason.alias("_error"))
    ok, seen = F.col("_error").isNull(), Observation()
    rows = apply(rows, results, {"chunk_status": F.when(ok, CHUNKED).otherwise(FAILED), "nb_chunks": F.coalesce("_leaves", F.lit("")), "last_chunk_time": _now(), "chunk_error": F.coalesce("_error", F.lit("")), "chunk_config_hash": F.lit(settings)} | {f: F.when(ok, PENDING).otherwise("") if f == "index_status" else F.lit("") for f in INDEX_FIELDS}, seen, "chunk_status", CHUNKED)
    removed = old.select("source_id").distinct().join(kept.select("source_id").distinct(), "source_id", "left_anti").count()
    commit.write("chunks", kept.join(targets, "source_id", "left_anti").unionByName(new, allowMissingColumns=True))
    counts = _publish(commit, rows, "chunk_status")
    return {"chunk_status_counts": counts} | seen.get | {"config_hash": settings, "stale_removed": removed}


def run_indexing(spark: SparkSession, layout: Layout, step: Index) -> dict:
    commit = Commit(spark, layout.root)
    rows = _registry(commit)
    chunks = commit.read("chunks", chunking.CHUNK).where("level = 'leaf'")
    settings = config_hash(step.config)
    have = chunks.select("source_id").distinct()
    targets = materialize(R.index_targets(rows, have, settings, step.force, list(step.sources), step.limit).select("source_id", (F.lit(step.force) | (F.col("index_config_hash") != settings)).alias("again")).distinct(), "targets")
    active = rows.where((F.col("extraction_status") == EXTRACTED) & (F.col("chunk_status") == CHUNKED))
    facts = rows.select("source_id", "filename", "nature", "ext", "origin_path", "canonical_path", "modified_time").dropDuplicates(["source_id"])
    leaves = index.last_wins(chunks.join(targets.select("source_id"), "source_id"), "text")
    desired = index.flatten(leaves, facts, step.config.model)
    mine = buckets.read(commit, "index", INDEX_SCHEMA, targets).join(targets, "source_id")
    stay = mine.where("NOT again").drop("again")
    todo = desired.join(stay.select("chunk_id"), "chunk_id", "left_anti")
    texts, calls = todo.select("chunk_id", "text"), {"batch_size": step.config.batch_size, "max_retries": step.config.max_retries, "base_delay": step.config.base_delay}
    embedded = embed_once(texts, step.make, step.ledger, step.config.model, **calls) if step.ledger else embed_texts(texts, step.make, **calls)
    new = materialize(embedded, "vectors")
    merged = materialize(index.merge(stay, desired, new), "merged")
    stats = index.upsert_stats(index.diff(mine.where("NOT again"), desired)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "newly_embedded", "unchanged", "stale_deleted")]).first()
    counts = merged.groupBy("source_id").agg(F.count(F.lit(1)).cast("string").alias("_n"))
    results = targets.select("source_id").join(counts, "source_id", "left")
    ok, seen = F.col("_n").isNotNull(), Observation()
    rows = apply(rows, results, {"index_status": F.when(ok, INDEXED).otherwise(FAILED), "indexed_chunks": F.coalesce("_n", F.lit("")), "last_index_time": _now(), "index_error": F.when(ok, "").otherwise("no leaf chunks"), "index_config_hash": F.lit(settings)}, seen, "index_status", INDEXED)
    places = buckets.read(commit, "index", INDEX_SCHEMA).select("chunk_id", "source_id")
    gone = mine.select("chunk_id", "source_id").join(merged.select("chunk_id"), "chunk_id", "left_anti")
    removed = 0
    if not step.keep_stale:
        stale = materialize(places.join(active.select("source_id").distinct(), "source_id", "left_anti").select("chunk_id", "source_id"), "stale")
        removed = stale.select("source_id").distinct().count()
        gone = gone.unionByName(stale).distinct()
    written = buckets.change(commit, "index", INDEX_SCHEMA, merged, gone)
    counts = _publish(commit, rows, "index_status")
    return {"index_status_counts": counts} | seen.get | {"config_hash": settings, "stale_removed": removed} | written | stats.asDict()


def run_update(spark: SparkSession, layout: Layout, convert: Convert = Convert(), scan: Scan = Scan(), chunk: Chunk = Chunk(), index: Index = Index()) -> dict:
    """The enabled steps in order; what each has to say, by name."""
    results = {}
    if not scan.converted and exists(spark, layout.converted) or convert.enabled:
        scan = replace(scan, converted=scan.converted or layout.converted, raw=scan.raw or convert.raw or (scan.roots[0] if scan.roots else ""))
    if convert.enabled:
        if not exists(spark, convert.raw):
            raise FileNotFoundError(convert.raw or "the raw folder is not set")
        done, removed = files.run_conversion(spark, convert.raw, layout.converted, convert.dry_run, convert.keep_stale, convert.limit, convert.force, convert.timeout)
        results["convert"] = R.conversion_summary(done).first().asDict() | {"stale_removed": removed}
    for name, step, run in (("scan_extract", scan, scan_and_extract), ("chunk", chunk, run_chunking), ("index", index, run_indexing)):
        if step.enabled:
            results[name] = run(spark, layout, step)
    return results


