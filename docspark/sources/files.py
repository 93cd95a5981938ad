"""File sources and sinks: corpus scans, unit readers, JSONL, registry snapshots, conversion."""

from __future__ import annotations

import hashlib
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.chunking import document_stats, materialize_units
from docspark.operators.registry import normalize_registry, stale_converted, to_hash
from docspark.schemas import REGISTRY
from docspark.storage import delete, materialize, read_version, write_version

# What a scan takes, and what conversion makes of legacy formats.
SUPPORTED = (".pdf", ".docx", ".pptx")
LEGACY = {".doc": ".docx", ".ppt": ".pptx"}


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: Bytes, and names, that one task should read; bytes of a file that it holds while hashing.
SHARE, PATHS, BLOCK = 256 << 20, 10_000, 4 << 20
# Names of a store in Spark and in pyarrow.
STORES = {"s3a": "s3", "s3n": "s3"}
Opener = Callable[[str], BinaryIO]


def list_files(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Files of all roots, each path once: path, ext, filename, size_bytes, modified_time. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", "modificationTime")
    rows = files.select("path", _suffix(F.col("path")).alias("ext"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").cast("string").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"))
    return rows.where(F.col("ext").isin(*extensions)).dropDuplicates(["path"])


def legacy_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of legacy formats in order of path, without the lock files that editors leave."""
    return list_files(spark, [root], tuple(LEGACY)).where(~F.col("filename").startswith("~$")).orderBy("path")


def converted_path(source: Column, raw: str, converted: str) -> Column:
    """The same place under ``converted``, with the modern suffix."""
    rest = F.substring(source, len(raw.rstrip("/")) + 1, 1 << 30)
    suffix = F.lower(F.regexp_extract(rest, r"(\.[^./]+)$", 1))
    modern = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LEGACY.items() for x in pair]), suffix), suffix)
    return F.concat(F.lit(converted.rstrip("/")), F.regexp_replace(rest, r"\.[^./]+$", ""), modern)


def open_input(path: str) -> BinaryIO:
    """The file at a path or URI as a stream; a store other than the local one is opened by pyarrow's file systems, without Spark's own settings for it."""
    local = re.sub("^file:/*", "/", path)
    if local.startswith("/"):
        return open(local, "rb")
    scheme, rest = path.split("://", 1)
    authority, key = rest.split("/", 1)
    store, _ = pafs.FileSystem.from_uri(f"{STORES.get(scheme, scheme)}://{authority}/")
    return store.open_input_stream(f"/{key}" if scheme == "hdfs" else f"{authority}/{key}")


def dealt(wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, and size_bytes where it is known) as distinct (path, ext), in as many tasks as its bytes need. Names stay in Spark, one task a name."""
    size = F.coalesce(F.expr("try_cast(size_bytes AS bigint)"), F.lit(0)) if "size_bytes" in wanted.columns else F.lit(0)
    names = materialize(wanted.groupBy("path").agg(F.max(size).alias("size")), "names")
    total = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-total["bytes"] // SHARE), -(-total["n"] // PATHS))
    return names.repartition(max(1, min(total["n"], tasks)), "path").select("path", _suffix(F.col("path")).alias("ext"))


def hash_files(wanted: DataFrame, opener: Opener = open_input) -> DataFrame:
    """(path, sha256) of the ``wanted`` paths, and of no others; those that are gone have no row.

    A task holds one block of one file, so files may be of any size; content is in no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in frames:
            rows = []
            for path in names["path"]:
                try:
                    with opener(path) as f:
                        digest = hashlib.sha256()
                        while block := f.read(BLOCK):
                            digest.update(block)
                except FileNotFoundError:
                    continue
                rows.append((path, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "sha256"])

    return dealt(wanted).mapInPandas(run, "path string, sha256 string")


def scan_corpus(spark: SparkSession, roots: list[str], registry: DataFrame, extensions: tuple[str, ...] = SUPPORTED, opener: Opener = open_input) -> DataFrame:
    """What ``reconcile`` reads of the files under the roots: canonical_path, content_hash, filename, ext, size_bytes, modified_time.

    Only files that ``registry`` doesn't know with this size and time are read and hashed, in blocks.
    """
    listing = list_files(spark, roots, extensions).withColumnRenamed("path", "canonical_path")
    fresh = to_hash(registry, listing).select(F.col("canonical_path").alias("path"), "size_bytes")
    hashes = hash_files(fresh, opener).select(F.col("path").alias("canonical_path"), F.col("sha256").alias("content_hash"))
    known = registry.where("canonical_path <> ''").groupBy("canonical_path").agg(F.max("content_hash").alias("_known"))
    rows = listing.join(hashes, "canonical_path", "left").join(known, "canonical_path", "left")
    # a file that went before it was hashed is as if it had not been listed
    return rows.withColumn("content_hash", F.coalesce("content_hash", "_known")).where("content_hash IS NOT NULL").drop("_known")


def read_pdf(content: bytes) -> list[dict]:
    import fitz  # PyMuPDF, where installed

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [{"unit_type": "page", "unit_index": i + 1, "text": page.get_text()} for i, page in enumerate(pdf)]


def read_docx(content: bytes) -> list[dict]:
    import io

    import docx  # python-docx, where installed

    paragraphs = [(p.text.strip(), (p.style.name or "").lower().startswith("heading")) for p in docx.Document(io.BytesIO(content)).paragraphs]
    return group_paragraphs([p for p in paragraphs if p[0]])


def group_paragraphs(paragraphs: list[tuple[str, bool]]) -> list[dict]:
    """Sections that begin at headings, or a unit per paragraph if there are none."""
    if not any(h for _, h in paragraphs):
        return [{"unit_type": "paragraph", "unit_index": i + 1, "text": t} for i, (t, _) in enumerate(paragraphs)]
    out: list[dict] = []
    for text, heading in paragraphs:
        if heading or not out:
            out.append({"unit_type": "section", "unit_index": len(out) + 1, "text": text, "title": text if heading else None})
        else:
            out[-1]["text"] += "\n" + text
    return out


def read_pptx(content: bytes) -> list[dict]:
    import io

    import pptx  # python-pptx, where installed

    out = []
    for i, slide in enumerate(pptx.Presentation(io.BytesIO(content)).slides):
        parts = [s.text_frame.text for s in slide.shapes if s.has_text_frame]
        if slide.has_notes_slide:
            parts.append(slide.notes_slide.notes_text_frame.text)
        out.append({"unit_type": "slide", "unit_index": i + 1, "text": "\n".join(parts)})
    return out


READERS: dict[str, Callable[[bytes], list[dict]]] = {".pdf": read_pdf, ".docx": read_docx, ".pptx": read_pptx}


def extract_units(wanted: DataFrame, readers: dict[str, Callable[[bytes], list[dict]]] = READERS, opener: Opener = open_input) -> DataFrame:
    """(path, units, error): each ``wanted`` file by its suffix's reader, in the task that opens it; a failure stays with its row, a file that is gone has none."""
    unit = "struct<unit_type:string,unit_index:int,text:string,title:string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in frames:
            for path, ext in zip(names["path"], names["ext"]):
                try:
                    if ext not in readers:
                        raise ValueError(f"no reader for {ext}")
                    with opener(path) as f:
                        row = (path, [{"title": None} | u for u in readers[ext](f.read())], None)
                except FileNotFoundError:
                    continue
                except Exception as e:  # each file succeeds or fails by itself
                    row = (path, [], f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "units", "error"])

    return dealt(wanted).mapInPandas(run, f"path string, units array<{unit}>, error string")


META = ("source_id", "origin_path", "canonical_path", "filename", "nature", "ext", "modified_time")


def extracted_records(found: DataFrame) -> DataFrame:
    """``found`` (META, units as read, error) to extracted records: source_id, text, units with offsets, stats, meta, error.

    A document without text is an error of its row.
    """
    rows = found.withColumn("d", materialize_units(F.col("units")))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.trim("d.text") == "", "empty extracted text")
    return rows.select("source_id", F.col("d.text").alias("text"), F.col("d.units").alias("units"), document_stats(F.col("d.text"), F.col("d.units")).alias("stats"), F.struct(*META).alias("meta"), error.alias("error"))


def read_registry(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    """Registry rows of a versioned table or CSV file; none if it doesn't exist, unless it must."""
    if not path.endswith(".csv"):
        return normalize_registry(read_version(spark, path, None if must_exist else REGISTRY))
    try:
        return normalize_registry(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) or must_exist:
            raise
        return spark.createDataFrame([], REGISTRY)


def write_registry(rows: DataFrame, path: str) -> None:
    """A new version, or a CSV file; ``rows`` may come from the version before."""
    rows = normalize_registry(rows)
    if path.endswith(".csv"):
        rows.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        write_version(rows, path)


def first_bad_line(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(file, line from 1) of the first line, by file and place, that is no JSON; None if all are.

    Large files are read in several tasks. One job counts the lines of each part of a file and finds its first bad one;
    sums over the parts before it make a line of it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # rows of a part follow one another, so identifiers differ by lines
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    parts = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), (F.min(F.when(bad, F.col("at"))) - F.min("at")).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = parts.withColumn("line", F.col("bad") + before + 1).where("bad IS NOT NULL").orderBy("file", "start").select("file", "line").first()
    return tuple(found) if found else None


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lines. Blank lines and lines that hold something else than an object are left out; what is no JSON fails at once with its file and line.

    Files are read twice, to check them and to parse them, in parts of ``spark.sql.files.maxPartitionBytes``.
    """
    if bad := first_bad_line(spark, path):
        raise ValueError(f"no JSON: {bad[0]}:{bad[1]}")
    objects = spark.read.text(path).where(F.ltrim("value").startswith("{"))
    return objects.select(F.from_json("value", schema).alias("x")).select("x.*")


def convert(source: str, destination: str, dry_run: bool = False, force: bool = False, timeout: int = 180, run=subprocess.run) -> tuple[str, str]:
    """(status, detail) of converting one legacy file: OK, SKIP, FAIL or DRYRUN.

    The office program writes into a folder of its own beside the destination; only a file that
    isn't empty moves into place, so what was there stays until then, and stays after a failure.
    """
    made, old = Path(destination), Path(source)
    if not force and made.is_file() and made.stat().st_size and made.stat().st_mtime >= old.stat().st_mtime:
        return "SKIP", "up to date"
    if dry_run:
        return "DRYRUN", "would convert"
    made.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix=".converting-", dir=made.parent) as folder:
        command = [shutil.which("soffice") or "soffice", "--headless", "--convert-to", made.suffix[1:], "--outdir", folder, source]
        try:
            done = run(command, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return "FAIL", f"timeout after {timeout} s"
        except OSError as e:
            return "FAIL", str(e)
        said = next((t.strip() for t in (done.stderr, done.stdout) if t and t.strip()), "")
        if done.returncode:
            return "FAIL", f"exit {done.returncode}: {said}"
        # the program may write the name in another case
        found = next((f for f in Path(folder).iterdir() if f.name.lower() == f"{old.stem}{made.suffix}".lower()), None)
        if found is None or not found.stat().st_size:
            return "FAIL", f"{'no' if found is None else 'empty'} output{': ' + said if said else ''}"
        found.replace(made)
    return "OK", ""


def run_conversion(spark: SparkSession, raw: str, converted: str, dry_run: bool = False, keep_stale: bool = False, limit: int = 0, force: bool = False, timeout: int = 180, run=subprocess.run) -> tuple[DataFrame, int]:
    """((source, destination, status, detail) of each legacy file, number of stale converted files removed). Folders must be mounted where tasks run."""
    plan = legacy_files(spark, raw).select(F.regexp_replace("path", "^file:/*", "/").alias("source"))
    expected = plan = plan.withColumn("destination", converted_path(F.col("source"), raw, converted))
    plan = plan.orderBy("source").limit(limit) if limit > 0 else plan

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(s, d, *convert(s, d, dry_run, force, timeout, run)) for s, d in zip(pdf["source"], pdf["destination"])]
            yield pd.DataFrame(rows, columns=["source", "destination", "status", "detail"])

    # written once: a result that is read twice must not convert twice
    rows = materialize(plan.repartition("source").mapInPandas(each, "source string, destination string, status string, detail string"), "converted")
    removed = 0
    if not keep_stale:
        there = list_files(spark, [converted], tuple(LEGACY.values())).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
        for r in stale_converted(there, expected.select(F.col("destination").alias("path"))).toLocalIterator():
            removed += dry_run or delete(spark, r["path"])
    return rows, removed
