"""Registered queries over the shared tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from docspark import buckets, pipeline, storage
from docspark.config import LEAF, PARENT, Chunking, Prompts, Retrieval, Window
from docspark.functions import text as X
from docspark.functions.arrow import bounded
from docspark.operators import answers, chunking, index, inverted_file, registry, retrieval
from docspark.sources import admin, files

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id: the doc_id as text, text, units: its non-blank lines)."""
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(F.lit("paragraph").alias("unit_type"), (i + 1).alias("unit_index"), t.alias("text")))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), chunking.materialize_units(lines).alias("d"))
    return rows.select("source_id", "d.text", "d.units")


# ---- text and units ----

DIRTY = "\r\n\r\n\x0b\n  end\x07 of\tit  "
_NORM = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\r\n|\r|\x0B', chr(10), 'g'), '[\x00-\x08\x0C\x0E-\x1F\x7F]', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
"""


@query(f"""SELECT doc_id, sha256({_NORM.format(t="text || chr(13)||chr(10)||chr(13)||chr(10)||chr(11)||chr(10)||'  end'||chr(7)||' of'||chr(9)||'it  '")}) AS norm_sha256 FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize(F.concat("text", F.lit(DIRTY))), 256).alias("norm_sha256"))


_UNITS = """
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
kept AS (SELECT *, row_number() OVER w AS k, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_char FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
"""


@query(f"WITH {_UNITS} SELECT doc_id::VARCHAR AS source_id, i::INT AS unit_index, start_char, (start_char + length(line))::INT AS end_char FROM kept")
def unit_split_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer: an inner explode of a column infers a filter below it, which computes the column over again
    units = documents(spark, sf_dir).select("source_id", F.explode_outer("units").alias("u")).where("u IS NOT NULL")
    return units.select("source_id", "u.unit_index", "u.start_char", "u.end_char")


_TAGS = r"<(h1|p)>([^<]*)</"


@query(rf"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '{_TAGS}', 1) AS tags, regexp_extract_all(html, '{_TAGS}', 2) AS texts FROM pages),
p AS (SELECT page_id, generate_subscripts(tags, 1) AS i, unnest(tags) = 'h1' AS h, unnest(texts) AS x FROM t),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY page_id ORDER BY i) AS g FROM p),
s AS (SELECT page_id, g, max(CASE WHEN h THEN x END) AS title, string_agg(x, chr(10) ORDER BY i) AS body FROM n GROUP BY 1, 2)
SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY g)::INT AS section, title, sha256(body) AS text_sha256 FROM s""")
def section_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, texts = (F.regexp_extract_all("html", F.lit(_TAGS), F.lit(i)) for i in (1, 2))
    rows = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("pos", "p"))
    rows = rows.select(F.col("page_id").alias("doc"), "pos", F.col("p.text").alias("text"), (F.col("p.tag") == "h1").alias("is_heading"))
    return chunking.sections(rows).select(F.col("doc").alias("page_id"), "section", "title", F.sha2("text", 256).alias("text_sha256"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p, regexp_extract_all(text, '\S+') AS w FROM documents),
x AS (SELECT doc_id, generate_subscripts(p, 1) AS k, length(unnest(p)) AS n, length(unnest(w)) AS m FROM t),
y AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS e, m FROM x)
SELECT doc_id, count(*)::INT AS n_spans, sum((e - m) * k)::BIGINT AS starts, sum(e * k)::BIGINT AS ends FROM y GROUP BY 1""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all tokens, shown as sums that depend on each span's place and offsets."""
    spans = bounded(load(spark, sf_dir, "documents")).select("doc_id", X.token_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    total = lambda end: F.aggregate(F.transform("spans", lambda x, i: x[end].cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return spans.select("doc_id", F.size("spans").alias("n_spans"), total("s").alias("starts"), total("e").alias("ends"))


# ---- windows and chunks ----


def _windows_sql(w: Window, last: str) -> str:
    """CTEs up to ``last`` (source_id, k, s, e), and tok (spans of tokens) and body (materialised text)."""
    p = w.level
    return rf"""
{p}_w AS (
  SELECT source_id, n, b, 0 AS k, 0 AS s FROM bound WHERE n > 0
  UNION ALL
  SELECT source_id, n, b, k + 1, CASE WHEN e - {w.overlap_tokens} > s THEN e - {w.overlap_tokens} ELSE e END FROM (
    SELECT *, coalesce(list_min(list_transform(list_filter(b, lambda x: x >= s + {w.min_tokens} AND x <= s + {w.max_tokens}), lambda x: abs(x - s - {w.target_tokens}) * 1000000 + x)) % 1000000, s + {w.target_tokens}) AS e FROM {p}_w WHERE n - s > {w.max_tokens})
),
{p}_e AS (SELECT source_id, n, k, s, lead(s) OVER (PARTITION BY source_id ORDER BY k) AS nx, b, max(k) OVER (PARTITION BY source_id) AS m FROM {p}_w),
{p}_f AS (SELECT *, CASE WHEN k = m THEN n ELSE coalesce(list_min(list_transform(list_filter(b, lambda x: x >= s + {w.min_tokens} AND x <= s + {w.max_tokens}), lambda x: abs(x - s - {w.target_tokens}) * 1000000 + x)) % 1000000, s + {w.target_tokens}) END AS e, k = m AND k > 0 AND n - s < {w.min_tokens} AS short FROM {p}_e),
{last} AS (SELECT source_id, k, s::INT AS s, (CASE WHEN lead(short) OVER (PARTITION BY source_id ORDER BY k) THEN n ELSE e END)::INT AS e, short FROM {p}_f QUALIFY NOT short)
"""


_BOUND = rf"""
{_UNITS},
tk AS (SELECT doc_id, k, len(regexp_extract_all(line, '\S+')) AS c FROM kept),
cum AS (SELECT doc_id, sum(c) OVER (PARTITION BY doc_id ORDER BY k) AS b, sum(c) OVER (PARTITION BY doc_id) AS n FROM tk),
bound AS (SELECT doc_id::VARCHAR AS source_id, max(n)::INT AS n, coalesce(list(DISTINCT b::INT) FILTER (WHERE b > 0 AND b < n), []) AS b FROM cum GROUP BY 1)
"""


def _windows(spark: SparkSession, sf_dir: str, w: Window) -> DataFrame:
    return chunking.token_windows(documents(spark, sf_dir), w)


@query(f"WITH RECURSIVE {_BOUND}, {_windows_sql(LEAF, 'lw')} SELECT source_id, k::INT AS k, s, e FROM lw")
def leaf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, LEAF)


@query(f"WITH RECURSIVE {_BOUND}, {_windows_sql(PARENT, 'pw')} SELECT source_id, k::INT AS k, s, e FROM pw")
def parent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, PARENT)


@query(f"WITH {_BOUND} SELECT source_id, n AS n_tokens, unnest(list_sort(b)) AS boundary FROM bound")
def unit_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.unit_boundaries(documents(spark, sf_dir))


_CHUNKS = rf"""
body AS (SELECT doc_id::VARCHAR AS source_id, string_agg(line, chr(10) || chr(10) ORDER BY k) AS text FROM kept GROUP BY 1),
pieces AS (SELECT source_id, regexp_extract_all(text, '\s*\S+') AS p FROM body),
cut AS (
  SELECT level, source_id, k, e - s AS token_count, (te - length(ltrim(p[s + 1], ' ' || chr(10) || chr(9))))::INT AS start_char, (te + coalesce(list_sum(list_transform(p[s + 2:e], lambda x: length(x))), 0))::INT AS end_char, p[s + 1:e] AS own
  FROM (SELECT l.*, p, list_sum(list_transform(p[1:s + 1], lambda x: length(x))) AS te FROM (SELECT 'leaf' AS level, * FROM lw UNION ALL SELECT 'parent', * FROM pw) l JOIN pieces USING (source_id))),
text AS (SELECT * EXCLUDE own, ltrim(array_to_string(own, ''), ' ' || chr(10) || chr(9)) AS text FROM cut),
chunk AS (SELECT *, sha256(concat_ws(':', source_id, level, start_char::VARCHAR, end_char::VARCHAR, sha256(text))) AS chunk_id FROM text),
linked AS (SELECT *, lag(chunk_id, 1, '') OVER w AS prev_id, lead(chunk_id, 1, '') OVER w AS next_id FROM chunk WINDOW w AS (PARTITION BY source_id, level ORDER BY start_char, end_char, chunk_id)),
par AS (SELECT source_id, chunk_id AS parent_id, start_char AS ps, end_char AS pe, row_number() OVER (PARTITION BY source_id ORDER BY start_char, end_char) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS np FROM chunk WHERE level = 'parent'),
near AS (SELECT l.chunk_id, least((SELECT count(*) FROM par q WHERE q.source_id = l.source_id AND q.pe <= l.start_char), max(p.np) - 1) AS at, any_value(l.source_id) AS source_id, any_value(l.start_char) AS s, any_value(l.end_char) AS e FROM chunk l JOIN par p USING (source_id) WHERE l.level = 'leaf' GROUP BY l.chunk_id, l.source_id, l.start_char),
best AS (SELECT n.chunk_id, p.parent_id FROM near n JOIN par p ON p.source_id = n.source_id AND p.i BETWEEN n.at - 1 AND n.at + 1
  QUALIFY row_number() OVER (PARTITION BY n.chunk_id ORDER BY greatest(0, least(n.e, p.pe) - greatest(n.s, p.ps)) DESC, CASE p.i - n.at WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) = 1)
"""
_ALL = f"{_BOUND}, {_windows_sql(LEAF, 'lw')}, {_windows_sql(PARENT, 'pw')}, {_CHUNKS}"


@query(f"WITH RECURSIVE {_ALL} SELECT chunk_id, source_id, token_count, start_char, end_char, prev_id, next_id FROM linked WHERE level = 'leaf'")
def leaf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_chunks(documents(spark, sf_dir))[0].select("chunk_id", "source_id", "token_count", "start_char", "end_char", "prev_id", "next_id")


@query(f"WITH RECURSIVE {_ALL} SELECT chunk_id, source_id, token_count, start_char, end_char, prev_id, next_id FROM linked WHERE level = 'parent'")
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_chunks(documents(spark, sf_dir))[1].select("chunk_id", "source_id", "token_count", "start_char", "end_char", "prev_id", "next_id")


@query(f"""WITH RECURSIVE {_ALL}, u AS (SELECT doc_id::VARCHAR AS source_id, i, start_char AS us, start_char + length(line) AS ue FROM kept)
SELECT chunk_id, any_value(c.level) AS level, 'paragraph' AS unit_type_start, (min(i) FILTER (WHERE ue > c.start_char))::INT AS unit_index_start, 'paragraph' AS unit_type_end, (max(i) FILTER (WHERE us < c.end_char))::INT AS unit_index_end
FROM chunk c JOIN u USING (source_id) GROUP BY chunk_id""")
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units in which chunks of both levels begin and end."""
    return chunking.chunk(documents(spark, sf_dir)).select("chunk_id", "level", "unit_type_start", "unit_index_start", "unit_type_end", "unit_index_end")


@query(f"WITH RECURSIVE {_ALL} SELECT chunk_id, parent_id FROM best")
def leaf_parent_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, _ = chunking.build_chunks(documents(spark, sf_dir))
    return leaves.select("chunk_id", "parent_id")


@query(f"""WITH RECURSIVE {_ALL}, m AS (SELECT *, max(token_count) OVER (PARTITION BY source_id) AS most, row_number() OVER (PARTITION BY source_id ORDER BY token_count DESC, start_char) AS r FROM chunk WHERE level = 'leaf')
SELECT chunk_id, token_count FROM m WHERE token_count >= 300 OR (most < 300 AND r = 1)""")
def short_leaf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_chunks(documents(spark, sf_dir), Chunking(min_leaf_tokens=300))[0].select("chunk_id", "token_count")


# ---- registry ----


@query("SELECT sha256(text) AS source_id, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("source_id")).agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT coalesce(event_type, '') AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.status_counts(load(spark, sf_dir, "events"), "event_type")


@query("""SELECT count(*) FILTER (WHERE event_id % 5 = 0) AS "OK", count(*) FILTER (WHERE event_id % 5 = 1) AS "SKIP", count(*) FILTER (WHERE event_id % 5 IN (2, 3)) AS "FAIL", count(*) FILTER (WHERE event_id % 5 = 9) AS "DRYRUN" FROM events""")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("event_id") % 5
    return registry.conversion_summary(load(spark, sf_dir, "events").select(F.when(part == 0, "OK").when(part == 1, "SKIP").when(part < 4, "FAIL").otherwise("other").alias("status")))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("EXTRACTED", "NEW", "FAILED", "MISSING")]), (F.col("doc_id") % 4 + 1).cast("int"))
    v1 = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("v1")), 256)
    rows = load(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select(v1.alias("source_id"), v1.alias("content_hash"), F.concat(F.lit("p"), "doc_id").alias("canonical_path"), F.col("n_chars").cast("string").alias("size_bytes"), F.lit("t1").alias("modified_time"), status.alias("extraction_status"), F.when(status == "EXTRACTED", "CHUNKED").otherwise("").alias("chunk_status"))
    return registry.normalize_registry(rows)


@query("""
WITH d AS (SELECT doc_id, doc_id % 10 AS c, ['EXTRACTED', 'NEW', 'FAILED', 'MISSING'][doc_id % 4 + 1] AS st, doc_id % 2 = 0 AS art FROM documents),
r AS (SELECT *, CASE WHEN c = 1 THEN 'MISSING' WHEN c IN (0, 3) THEN 'NEW' WHEN st = 'MISSING' THEN CASE WHEN art THEN 'EXTRACTED' ELSE 'NEW' END
  WHEN c IN (2, 4) AND st = 'FAILED' THEN 'NEW' ELSE st END AS extraction_status FROM d)
SELECT CASE WHEN c = 2 THEN 'q' ELSE 'p' END || doc_id AS canonical_path, sha256(doc_id || CASE WHEN c = 3 THEN 'v2' ELSE 'v1' END) AS source_id, extraction_status,
  CASE WHEN extraction_status <> 'EXTRACTED' THEN '' WHEN st = 'EXTRACTED' THEN 'CHUNKED' ELSE 'PENDING' END AS chunk_status FROM r""")
def registry_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, doc = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    scan = load(spark, sf_dir, "documents").where(c != 1).select(
        F.concat(F.when(c == 2, "q").otherwise("p"), doc).alias("canonical_path"), F.sha2(F.concat(doc, F.when(c == 3, "v2").otherwise("v1")), 256).alias("content_hash"), doc.alias("filename"), F.lit("n").alias("nature"), F.lit(".pdf").alias("ext"), doc.alias("origin_path"),
        F.col("n_chars").cast("string").alias("size_bytes"), F.when(c.isin(3, 4), "t2").otherwise("t1").alias("modified_time"), F.lit("now").alias("seen_at"), (F.col("doc_id") % 2 == 0).alias("artifact_exists"),
    )
    return registry.reconcile(_registry(spark, sf_dir), scan).select("canonical_path", "source_id", "extraction_status", "chunk_status")


def _tracked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registry rows in every state of chunking and indexing, and the sources that have chunks."""
    doc = F.expr("CAST(substr(canonical_path, 2) AS BIGINT)")
    when = lambda n, hit, other: F.when(doc % n == 0, hit).otherwise(other)
    rows = _registry(spark, sf_dir).withColumns({
        "chunk_status": F.when(doc % 11 == 0, "PENDING").otherwise(F.col("chunk_status")), "chunk_config_hash": when(7, "x", "c"), "index_config_hash": when(7, "x", "c"),
        "index_status": when(5, "FAILED", "INDEXED"), "nb_chunks": F.lit("2"), "indexed_chunks": when(13, "1", "2"),
    })
    have = load(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("v1")), 256).alias("source_id"))
    return rows, have


@query("SELECT sha256(doc_id || 'v1') AS source_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0 AND (doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 1)")
def chunk_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not chunked, chunked by other settings, or without chunks."""
    return registry.chunk_targets(*_tracked(spark, sf_dir), "c").select("source_id")


@query("SELECT sha256(doc_id || 'v1') AS source_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0 AND doc_id % 11 <> 0 AND (doc_id % 7 = 0 OR doc_id % 3 = 1 OR doc_id % 5 = 0 OR doc_id % 13 = 0)")
def index_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked, and not indexed, indexed by other settings or of another number of chunks, or without leaves."""
    return registry.index_targets(*_tracked(spark, sf_dir), "c").select("source_id")


@query("SELECT sha256(doc_id || 'v1') AS source_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0 ORDER BY 1 LIMIT 25")
def work_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced run over the first 25 sources."""
    return registry.chunk_targets(*_tracked(spark, sf_dir), "c", force=True, limit=25).select("source_id")


@query("""SELECT 'p' || doc_id AS canonical_path, sha256((doc_id // 2)::VARCHAR) AS content_hash, 'EXTRACTED' AS extraction_status FROM documents d
WHERE doc_id % 6 <> 4 OR NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id + 1)""")
def registry_equal_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal content: known paths keep their rows, an unknown greater path takes its twin's."""
    path, content = F.concat(F.lit("p"), "doc_id"), F.sha2(F.floor(F.col("doc_id") / 2).cast("string"), 256)
    docs = load(spark, sf_dir, "documents").select("doc_id", path.alias("canonical_path"), content.alias("content_hash"), F.lit("1").alias("size_bytes"), F.lit("t").alias("modified_time"))
    known = docs.where("doc_id % 6 <> 5").select(F.col("content_hash").alias("source_id"), "content_hash", "canonical_path", "size_bytes", "modified_time", F.lit("EXTRACTED").alias("extraction_status"))
    scan = docs.drop("doc_id").withColumns({c: F.lit("x") for c in ("filename", "nature", "ext", "origin_path", "seen_at")} | {"artifact_exists": F.lit(True)})
    return registry.reconcile(known, scan).select("canonical_path", "content_hash", "extraction_status")


@query("SELECT 'p' || doc_id AS canonical_path FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 1")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to hash: unknown ones, and those whose size or time is not the registry's."""
    doc = F.col("doc_id")
    size = F.col("n_chars") + F.when(doc % 7 == 0, 1).otherwise(0)
    listing = load(spark, sf_dir, "documents").select(F.concat(F.lit("p"), doc).alias("canonical_path"), size.cast("string").alias("size_bytes"), F.when(doc % 5 == 1, "t2").otherwise("t1").alias("modified_time"))
    return registry.to_hash(_registry(spark, sf_dir), listing).select("canonical_path")


@query("SELECT DISTINCT label::VARCHAR AS source_id FROM embeddings WHERE label NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("source_id"))
    return registry.orphan_sources(_vectors(spark, sf_dir), known)


@query("SELECT sha256(doc_id || 'v1') AS source_id, doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0")
def chunk_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stay for extracted sources only."""
    chunks = load(spark, sf_dir, "documents").select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("v1")), 256).alias("source_id"), "doc_id")
    return registry.purge_chunks(chunks, _registry(spark, sf_dir)).select("source_id", "doc_id")


@query("SELECT sha256(doc_id || 'v1') AS source_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 3")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = load(spark, sf_dir, "documents").select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("v1")), 256).alias("source_id"))
    return registry.missing_artifacts(_registry(spark, sf_dir), artifacts)


_PATHS = "'/raw/a.b/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.doc' WHEN 1 THEN '.PPT' ELSE '.docx' END"


@query("SELECT doc_id, '/made/a.b/' || doc_id || CASE doc_id % 3 WHEN 1 THEN '.pptx' ELSE '.docx' END AS path FROM documents")
def converted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATHS} AS source").select("doc_id", files.converted_path(F.col("source"), "/raw", "/made/").alias("path"))


@query("SELECT '/made/a.b/' || doc_id || '.docx' AS path FROM documents WHERE doc_id % 3 = 1")
def stale_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted files that no source leads to (of every document there is a .docx)."""
    docs = load(spark, sf_dir, "documents")
    there = docs.select(F.concat(F.lit("/made/a.b/"), "doc_id", F.lit(".docx")).alias("path"))
    return registry.stale_converted(there, docs.selectExpr(f"{_PATHS} AS source").select(files.converted_path(F.col("source"), "/raw", "/made").alias("path")))


@query("SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS processed, count(*) FILTER (WHERE doc_id % 4 = 2) AS failed FROM documents WHERE doc_id % 10 <> 0")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.run_counts(_registry(spark, sf_dir), "extraction_status", "EXTRACTED")


@query(f"WITH {_UNITS} SELECT doc_id::VARCHAR AS source_id, count(*)::INT AS unit_count, (sum(length(line)) + 2 * (count(*) - 1))::INT AS char_count, any_value(d.source) AS nature FROM kept JOIN documents d USING (doc_id) GROUP BY 1")
def extracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents with text: stats and meta."""
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(F.lit("paragraph").alias("unit_type"), (i + 1).alias("unit_index"), t.alias("text")))
    meta = [F.col("source").alias(c) if c == "nature" else F.lit("").alias(c) for c in files.META if c != "source_id"]
    found = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), *meta, lines.alias("units"), F.lit(None).cast("string").alias("error"))
    return files.extracted_records(found).where("error IS NULL").select("source_id", "stats.unit_count", "stats.char_count", "meta.nature")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS nature FROM documents")
def path_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("doc_id") % 3
    path = F.when(c == 0, F.concat(F.lit("/data/raw/corpus_v1/"), "source", F.lit("/a.pdf"))).when(c == 1, F.concat(F.lit("/data/raw/"), "lang", F.lit("/b.pdf"))).otherwise("/elsewhere/c.pdf")
    return load(spark, sf_dir, "documents").select("doc_id", X.nature_of(path, "/data/raw", "corpus_v1").alias("nature"))


@query("SELECT doc_id::VARCHAR AS stem, CASE WHEN doc_id % 3 = 0 THEN 'raw/' || doc_id || '.doc' WHEN doc_id % 3 = 1 THEN 'raw/' || doc_id || '.docx' END AS origin FROM documents")
def converted_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), (F.col("doc_id") % 3).alias("c"))
    raw = docs.where("c = 0").withColumn("ext", F.lit(".doc")).unionByName(docs.where("c < 2").withColumn("ext", F.lit(".docx")))
    raw = raw.select("stem", "ext", F.concat(F.lit("raw/"), "stem", "ext").alias("path"))
    return registry.origin_of(docs.select("stem", F.lit(".docx").alias("ext")), raw).select("stem", "origin")


# ---- index ----


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("label").orderBy("vec_id")
    rows = load(spark, sf_dir, "embeddings").withColumn("prev_id", F.lag("vec_id").over(w)).withColumn("next_id", F.lead("vec_id").over(w))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), "embedding", text("prev_id"), text("next_id"), F.concat(F.lit("parent-"), F.col("label").cast("string")).alias("parent_id"))


_DIFF = """
WITH d AS (SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS source_id, vec_id % 3 <> 0 AS old, vec_id % 5 <> 0 AS new FROM embeddings),
a AS (SELECT chunk_id, source_id, CASE WHEN NOT new THEN 'delete' WHEN NOT old THEN 'embed' ELSE 'keep' END AS action FROM d WHERE old OR new)
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"))
    return index.diff(rows.where("vec_id % 3 <> 0"), rows.where("vec_id % 5 <> 0"))


@query(_DIFF + "SELECT * FROM a")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(_DIFF + "SELECT source_id, count(*) FILTER (WHERE action <> 'delete') AS total, count(*) FILTER (WHERE action = 'embed') AS newly_embedded, count(*) FILTER (WHERE action = 'keep') AS unchanged, count(*) FILTER (WHERE action = 'delete') AS stale_deleted FROM a GROUP BY 1")
def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upsert_stats(_diff(spark, sf_dir))


@query("SELECT vec_id::VARCHAR AS chunk_id, round(CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE embedding[1]::DOUBLE END, 6) AS head FROM embeddings WHERE vec_id % 5 <> 0")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    fresh = rows.where("vec_id % 3 = 0 AND vec_id % 5 <> 0").select("chunk_id", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    merged = index.merge(rows.where("vec_id % 3 <> 0").select("chunk_id", "embedding"), rows.where("vec_id % 5 <> 0").select("chunk_id"), fresh)
    return merged.select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@query("""SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS source_id, CASE WHEN vec_id % 100 = 7 THEN 'second' WHEN vec_id % 10 = 3 THEN 'first' ELSE 'base' END AS text FROM embeddings
WHERE vec_id % 10 <> 1 OR vec_id % 100 = 11""")
def index_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in buckets after three commits: all rows; a tenth replaced and a tenth deleted; a few replaced, and a few of the deleted put back."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source_id"), F.lit("base").alias("text"))
    schema, root = "chunk_id string, source_id string, text string", storage.shared_dir(spark, "index-deltas")
    said = lambda where, text: rows.where(where).withColumn("text", F.lit(text))
    for put, gone in ((rows, "false"), (said("vec_id % 10 = 3", "first"), "vec_id % 10 = 1"), (said("vec_id % 100 = 7", "second").unionByName(said("vec_id % 100 = 11", "base")), "false")):
        commit = storage.Commit(spark, root)
        buckets.change(commit, "index", schema, put, rows.where(gone))
        commit.publish()
    return storage.read_version(spark, f"{root}/index")


@query("SELECT label::VARCHAR AS source_id, count(*) AS n FROM embeddings WHERE label::VARCHAR IN (SELECT source_id FROM (SELECT (doc_id % 7)::VARCHAR AS source_id FROM documents)) GROUP BY 1")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = load(spark, sf_dir, "documents").select((F.col("doc_id") % 7).cast("string").alias("source_id"))
    return index.active_only(_vectors(spark, sf_dir), active).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT source AS source_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 64)::INT AS batch, length(text) AS n FROM documents)
SELECT source_id, batch, count(*) AS texts, round(avg(n), 6) AS avg_chars, max(n)::INT AS max_chars FROM b GROUP BY 1, 2""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "doc_id", F.length("text").alias("n"))
    return index.batch_stats(index.batches(rows, order="doc_id"), "n")


@query("SELECT field, value FROM (SELECT DISTINCT 'nature' AS field, source AS value FROM documents UNION SELECT DISTINCT 'ext', lang FROM documents) WHERE trim(value) <> ''")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.filter_values(load(spark, sf_dir, "documents").select(F.col("source").alias("nature"), F.col("lang").alias("ext")), ["nature", "ext"])


@query("SELECT 'doc_' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))


_TREE = """WITH files AS (SELECT 'doc_' || doc_id AS path, coalesce(sha256(text), '') AS sha256 FROM documents),
leaves AS (SELECT substr(sha256(path), 1, 4) AS node, sha256(string_agg(path || '=' || sha256, ',' ORDER BY path)) AS sha256, count(*) AS n FROM files GROUP BY 1),
upper_nodes AS (SELECT substr(node, 1, 2) AS node, sha256(string_agg(node || '=' || sha256, ',' ORDER BY node)) AS sha256, sum(n) AS n FROM leaves GROUP BY 1)"""


@query(_TREE + " SELECT sha256(string_agg(node || '=' || sha256, ',' ORDER BY node)) AS sha256, sum(n)::BIGINT AS n FROM upper_nodes HAVING count(*) > 0")
def hash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of a manifest's tree of hashes."""
    return admin.hash_tree(hash_manifest(spark, sf_dir)).where("node = ''").select("sha256", "n")


@query(_TREE + " SELECT node, sha256, n::BIGINT AS n FROM upper_nodes UNION ALL SELECT node, sha256, n FROM leaves")
def hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.hash_tree(hash_manifest(spark, sf_dir)).where("node <> ''")


@query("""SELECT 'doc_' || doc_id AS path, CASE WHEN doc_id % 97 <> 5 THEN sha256(text) END AS before, CASE WHEN doc_id % 101 = 7 THEN sha256(text || '!') WHEN doc_id % 103 <> 9 THEN sha256(text) END AS after
FROM documents WHERE CASE WHEN doc_id % 97 <> 5 THEN sha256(text) END IS DISTINCT FROM CASE WHEN doc_id % 101 = 7 THEN sha256(text || '!') WHEN doc_id % 103 <> 9 THEN sha256(text) END""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that changed, new ones and ones that went, found by the trees of two manifests."""
    docs = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc_"), "doc_id").alias("path")
    before = docs.where("doc_id % 97 <> 5").select(path, F.sha2("text", 256).alias("sha256"))
    now = F.when(F.col("doc_id") % 101 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where("doc_id % 103 <> 9 OR doc_id % 101 = 7").select(path, F.sha2(now, 256).alias("sha256"))
    return admin.changed_files(before, after)


@query("""SELECT 'c' || doc_id AS chunk_id, source AS source_id, 'leaf' AS level, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '') AS nature, '' AS ext, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, 0)::INT AS end_char, 'm' AS embedding_model
FROM documents WHERE regexp_matches(text, '\\S')""")
def index_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves as index rows: absent text is empty, what is no number is 0, blank leaves are left out."""
    docs = load(spark, sf_dir, "documents")
    ends = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"))).otherwise("none")
    leaves = docs.select(F.concat(F.lit(" c"), "doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("nature"), ends.alias("end_char"))
    return index.flatten(leaves, model="m", strict=False).select("chunk_id", "source_id", "level", "nature", "ext", "end_char", "embedding_model")


# ---- retrieval ----

TOP, CAP = 6, 2
_KNN = """
v AS (SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS source_id, embedding::DOUBLE[] AS e, coalesce(lag(vec_id) OVER w::VARCHAR, '') AS prev_id, coalesce(lead(vec_id) OVER w::VARCHAR, '') AS next_id FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
knn AS (SELECT qid, chunk_id, source_id, prev_id, next_id, 1 - list_cosine_similarity(e, qe) AS distance, row_number() OVER (PARTITION BY qid ORDER BY round(1 - list_cosine_similarity(e, qe), 12), chunk_id)::INT AS rank FROM v, q WHERE {where} QUALIFY rank <= 24),
capped AS (SELECT * EXCLUDE (own, rank), row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY rank) AS own FROM knn) WHERE own <= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 6)
"""
_ANY = _KNN.format(where="true")
_HEAD = "qid, chunk_id, rank, round(distance, 6) AS distance"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of these searches: every vector whose id is divisible by 50."""
    return load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _knn(spark: SparkSession, sf_dir: str, filters=None) -> DataFrame:
    return retrieval.knn(_vectors(spark, sf_dir), _questions(spark, sf_dir), 24, filters)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {_ANY} SELECT {_HEAD} FROM knn")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir))


@query(f"WITH {_ANY} SELECT qid, chunk_id, rank, round(-distance, 6) + 0 AS score FROM knn")
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score as a search gives it: the distance, negated."""
    return _knn(spark, sf_dir).select("qid", "chunk_id", "rank", (F.round("score", 6) + 0).alias("score"))


@query()
def knn_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through an inverted file: approximate, so no SQL; tests measure its recall against ``knn``."""
    path = storage.shared_dir(spark, "inverted-file")
    inverted_file.build(_vectors(spark, sf_dir).select("chunk_id", "source_id", "embedding"), path)
    return _shown(inverted_file.search(spark, path, _questions(spark, sf_dir), 24))


@query(f"WITH {_ANY} SELECT {_HEAD} FROM knn")
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search as tables too large to send take it: parts of the index meet blocks of questions."""
    index = _vectors(spark, sf_dir).select("chunk_id", "embedding", F.lit(0).alias("cell"))
    return _shown(retrieval.search_cells(index, _questions(spark, sf_dir).withColumn("cell", F.lit(0)), 24, cell_rows=400, block=16))


@query(f"WITH {_KNN.format(where=chr(115) + 'ource_id IN (' + repr('1') + ', ' + repr('3') + ')')} SELECT {_HEAD} FROM knn")
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_knn(spark, sf_dir, retrieval.parse_filters(["source_id=1", "source_id=3"])))


@query(f"WITH {_ANY} SELECT {_HEAD} FROM capped")
def source_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(retrieval.capped_top(_knn(spark, sf_dir), CAP, TOP))


@query(f"WITH {_ANY}, o AS (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY rank) > 2 AS over FROM knn) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY over, rank)::INT AS rank, round(distance, 6) AS distance FROM o")
def soft_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(retrieval.soft_cap(_knn(spark, sf_dir), CAP))


@query(f"WITH {_ANY}, c AS (SELECT qid, source_id, count(*) AS n FROM knn WHERE rank <= 6 GROUP BY 1, 2) SELECT qid, round(max(n) / sum(n), 6) AS redundancy FROM c GROUP BY 1")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.redundancy(_knn(spark, sf_dir), TOP).select("qid", F.round("redundancy", 6).alias("redundancy"))


@query(f"""WITH RECURSIVE {_ANY},
u AS (SELECT chunk_id, CASE WHEN list_dot_product(e, e) <= 1e-12 THEN list_transform(e, lambda x: 0.0) ELSE list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) END AS x FROM v),
qu AS (SELECT qid, list_transform(qe, lambda x: x / sqrt(list_dot_product(qe, qe))) AS x FROM q),
g AS (SELECT k.qid, k.rank, list_dot_product(u.x, qu.x) AS gain, u.x FROM knn k JOIN u USING (chunk_id) JOIN qu USING (qid)),
s AS (SELECT a.qid, a.rank, any_value(a.gain) AS gain, list(list_dot_product(a.x, b.x) ORDER BY b.rank) AS sims FROM g a JOIN g b USING (qid) GROUP BY 1, 2),
m AS (
  SELECT qid, 1 AS step, [rank] AS chosen FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY round(gain, 12) DESC, rank) AS o FROM s) WHERE o = 1
  UNION ALL
  SELECT qid, step + 1, list_append(chosen, rank) FROM (
    SELECT m.qid, m.step, m.chosen, s.rank, row_number() OVER (PARTITION BY m.qid ORDER BY round(0.7 * gain - 0.3 * list_max(list_transform(m.chosen, lambda j: s.sims[j])), 12) DESC, s.rank) AS o
    FROM m JOIN s ON s.qid = m.qid AND NOT list_contains(m.chosen, s.rank) WHERE m.step < 12) WHERE o = 1
), p AS (SELECT qid, unnest(chosen) AS old, generate_subscripts(chosen, 1)::INT AS rank FROM m WHERE step = 12)
SELECT p.qid, k.chunk_id, p.rank, round(k.distance, 6) AS distance FROM p JOIN knn k ON k.qid = p.qid AND k.rank = p.old""")
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _knn(spark, sf_dir).join(_vectors(spark, sf_dir).select("chunk_id", "embedding"), "chunk_id")
    return _shown(retrieval.mmr(near, _questions(spark, sf_dir), 2 * TOP))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.capped_top(_knn(spark, sf_dir), CAP, TOP).withColumn("score", 1 - F.col("distance"))


def _expand_sql(depth: int) -> str:
    steps, have = "", "SELECT qid, chunk_id, rank, score, prev_id, next_id, NULL::VARCHAR AS expanded_from, NULL::INT AS expanded_depth FROM (SELECT *, 1 - distance AS score FROM capped)"
    steps = f", h0 AS ({have}), f0 AS (SELECT * FROM h0)"
    for d in range(1, depth + 1):
        steps += f""", t{d} AS (SELECT qid, chunk_id AS fid, rank, score, side, id FROM (SELECT *, 0 AS side, prev_id AS id FROM f{d - 1} UNION ALL SELECT *, 1, next_id FROM f{d - 1}) WHERE id <> ''),
b{d} AS (SELECT * FROM t{d} WHERE (qid, id) NOT IN (SELECT (qid, chunk_id) FROM h{d - 1}) QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, rank DESC) = 1),
f{d} AS (SELECT b.qid, b.id AS chunk_id, ((SELECT max(rank) FROM h{d - 1} h WHERE h.qid = b.qid) + row_number() OVER (PARTITION BY b.qid ORDER BY b.rank, b.side, b.id))::INT AS rank, greatest(0, b.score - {0.05 * d}) AS score, v.prev_id, v.next_id, b.fid AS expanded_from, {d} AS expanded_depth FROM b{d} b JOIN v ON v.chunk_id = b.id),
h{d} AS (SELECT * FROM h{d - 1} UNION ALL SELECT * FROM f{d})"""
    return f"WITH {_ANY}{steps} SELECT qid, chunk_id, rank, round(score, 6) AS score, expanded_from, expanded_depth FROM h{depth}"


def _expanded(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    rows = retrieval.expand_neighbors(_seeds(spark, sf_dir), _vectors(spark, sf_dir), depth)
    return rows.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"), "expanded_from", "expanded_depth")


@query(_expand_sql(1))
def neighbor_expand_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 1)


@query(_expand_sql(2))
def neighbor_expand_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 2)


@query(f"WITH {_ANY}, b AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY qid, source_id ORDER BY distance, rank) = 1), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, rank) <= 3) SELECT qid, 'parent-' || source_id AS chunk_id, round(greatest(0, 1 - distance - 0.03), 6) AS score, chunk_id AS expanded_from FROM t")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = load(spark, sf_dir, "embeddings").select(F.concat(F.lit("parent-"), F.col("label").cast("string")).alias("chunk_id")).distinct()
    return retrieval.expand_parents(_seeds(spark, sf_dir), store, 3).select("qid", "chunk_id", F.round("score", 6).alias("score"), "expanded_from")


@query(f"WITH {_ANY}, t AS (SELECT k.*, len(regexp_extract_all(d.text, '\\S+')) AS tokens FROM knn k JOIN documents d ON d.doc_id::VARCHAR = k.chunk_id), u AS (SELECT qid, chunk_id, rank, sum(tokens) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS used FROM t) SELECT * FROM u WHERE used <= 5000 OR rank = 1")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), X.token_count(F.col("text")).alias("tokens"))
    return retrieval.within_budget(_knn(spark, sf_dir).join(texts, "chunk_id"), 5000).select("qid", "chunk_id", "rank", "used")


@query("""SELECT doc_id, sha256('[C' || doc_id || ']' || chr(10) || 'source_id: ' || doc_id || chr(10) || 'filename: f' || doc_id || chr(10) || 'nature: ' || coalesce(source, '') || chr(10) || 'ext: ' || coalesce(lang, '') || chr(10)
  || 'unit: page ' || (doc_id % 9) || chr(10) || 'chunk_id: c' || doc_id || chr(10) || 'text:' || chr(10) || text || chr(10)) AS block_sha256 FROM documents""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    cells = {"source_id": doc, "filename": F.concat(F.lit("f"), doc), "nature": F.col("source"), "ext": F.col("lang"), "unit_type_start": F.lit("page"), "unit_index_start": (doc % 9).cast("string"), "chunk_id": F.concat(F.lit("c"), doc), "text": F.col("text")}
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(retrieval.context_block(doc, cells), 256).alias("block_sha256"))


_FIXED = " ".join(Prompts().__dict__.values())


@query(f"""SELECT item_id, (len(regexp_extract_all(text, '\\S+')) + {len(_FIXED.split())})::INT AS tokens FROM benchmark WHERE text IS NOT NULL""")
def prompt_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", retrieval.prompt_overhead(F.col("text"), Prompts()).alias("tokens"))


# ---- answers ----


def _ranked_sql(last: str) -> str:
    return _expand_sql(2).rsplit(" SELECT ", 1)[0] + f""",
scored AS (SELECT h.*, v.source_id, row_number() OVER (PARTITION BY h.qid ORDER BY round(h.score, 12) DESC, h.rank) AS place FROM h2 h JOIN v USING (chunk_id)),
final AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY own > 2, place)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_id ORDER BY place) AS own FROM scored)) {last}"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.expand_neighbors(_seeds(spark, sf_dir), _vectors(spark, sf_dir), 2).withColumn("score", F.round("score", 12))
    rows = rows.join(_vectors(spark, sf_dir).select("chunk_id", "source_id"), "chunk_id")
    return retrieval.soft_cap(retrieval.by_score(rows), CAP)


@query(_ranked_sql("SELECT qid, chunk_id, rank, round(score, 6) AS score FROM final"))
def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and neighbors by score, then the soft cap per source."""
    return _ranked(spark, sf_dir).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(_ranked_sql("""SELECT qid, 'First [C1], then [C2].' AS answer, 'C1=' || max(chunk_id) FILTER (WHERE rank = 2) || ',C2=' || max(chunk_id) FILTER (WHERE rank = 1) AS citations, string_agg(chunk_id, ',' ORDER BY rank) AS used FROM final GROUP BY qid"""))
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed reply that cites places 2 and 1 and one that doesn't exist, made into an answer for each question."""
    context = _ranked(spark, sf_dir)
    replies = _questions(spark, sf_dir).select("qid", F.lit("First [C2], then [C1]  [C999] .").alias("answer"))
    done = answers.finish(replies, context)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["label"], F.lit("="), c["chunk_id"])), ",")
    return done.select("qid", "answer", cited.alias("citations"), F.array_join(F.transform("used_chunks", lambda c: c["chunk_id"]), ",").alias("used"))


@query(_ranked_sql("""SELECT f.qid, CASE f.rank WHEN 2 THEN 'C1' ELSE 'C2' END AS label, f.chunk_id, f.source_id, CASE WHEN f.expanded_depth IS NULL THEN 'seed' ELSE 'expanded' END AS origin, CASE WHEN f.expanded_depth IS NULL THEN round(f.score, 6) END AS score,
  CASE o.rank WHEN 2 THEN 'C1' WHEN 1 THEN 'C2' END AS expanded_from_label, f.expanded_depth FROM final f LEFT JOIN final o ON o.qid = f.qid AND o.chunk_id = f.expanded_from AND o.rank <= 2 WHERE f.rank <= 2"""))
def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cited passages say of themselves: found ones their score, added ones where they come from."""
    replies = _questions(spark, sf_dir).select("qid", F.lit("First [C2], then [C1].").alias("answer"))
    cited = answers.finish(replies, _ranked(spark, sf_dir)).select("qid", F.explode("citations").alias("c"))
    return cited.select("qid", "c.label", "c.chunk_id", "c.source_id", "c.origin", "c.score", "c.expanded_from_label", "c.expanded_depth")


@query(_ranked_sql("SELECT qid, chunk_id, CASE WHEN expanded_depth IS NULL THEN round(score, 6) END AS score, expanded_depth FROM final"))
def used_chunk_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole context of an answer."""
    replies = _questions(spark, sf_dir).select("qid", F.lit("All [C1].").alias("answer"))
    used = answers.finish(replies, _ranked(spark, sf_dir)).select("qid", F.explode("used_chunks").alias("c"))
    return used.select("qid", "c.chunk_id", "c.score", "c.expanded_depth")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 10000 ELSE turn % 3 * 10 + conv_id % 7 END::INT AS place FROM conversations")
def citation_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, n = F.col("turn") % 3, F.col("turn") % 3 * 10 + F.col("conv_id") % 7
    label = F.when(third == 0, F.concat(F.lit("Cx"), n.cast("string"))).otherwise(F.concat(F.lit(" C"), n.cast("string"), F.lit(" ")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", X.label_order(label).alias("place"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' PAGE ' WHEN 1 THEN 'slide' WHEN 2 THEN 'Paragraph' WHEN 3 THEN ' ' || source || ' ' ELSE lang END AS raw FROM documents)
SELECT doc_id, CASE lower(trim(raw)) WHEN 'page' THEN 'Page' WHEN 'slide' THEN 'Slide' WHEN 'paragraph' THEN 'Paragraphe' ELSE coalesce(trim(raw), '') END AS name FROM r""")
def unit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("doc_id") % 5
    raw = F.when(c == 0, " PAGE ").when(c == 1, "slide").when(c == 2, "Paragraph").when(c == 3, F.concat(F.lit(" "), "source", F.lit(" "))).otherwise(F.col("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", X.unit_name(raw).alias("name"))


@query("""WITH f AS (SELECT doc_id AS qid, 'source' AS key, source AS value, 0 AS place FROM documents UNION ALL SELECT doc_id, 'lang', lang || '=x', 1 FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 2 = 0 THEN '' ELSE n_chars::VARCHAR END, 2 FROM documents)
SELECT qid, key, array_to_string(list(value ORDER BY place), '|') AS alternatives FROM f WHERE value IS NOT NULL GROUP BY 1, 2""")
def parse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three specifications a document, one of them with a second sign, one with blanks around it and sometimes without a value."""
    last = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("n_chars").cast("string"))
    specs = F.array_compact(F.array(F.concat(F.lit("source="), "source"), F.concat(F.lit(" lang = "), "lang", F.lit("=x")), F.concat(F.lit("source= "), last, F.lit(" "))))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), specs.alias("specs"))
    return retrieval.parse_filter_rows(rows).select("qid", "key", F.array_join("alternatives", "|").alias("alternatives"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with two labels each, of which C1 to C4 are valid."""
    a, b = ((F.col(c) % 7).cast("string") for c in ("turn", "conv_id"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("See [C"), a, F.lit("]   and [C"), b, F.lit("] .")).alias("answer"))


@query("SELECT conv_id, turn, CASE WHEN turn % 7 = conv_id % 7 THEN (turn % 7)::VARCHAR ELSE (turn % 7) || ',' || (conv_id % 7) END AS labels FROM conversations")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("conv_id", "turn", F.array_join(X.citation_labels(F.col("answer")), ",").alias("labels"))


@query("""WITH l AS (SELECT conv_id, turn, turn % 7 AS a, conv_id % 7 AS b FROM conversations), v AS (SELECT *, a BETWEEN 1 AND 4 AS va, b BETWEEN 1 AND 4 AS vb FROM l)
SELECT conv_id, turn, 'See' || CASE WHEN va THEN ' [C1]' ELSE '' END || ' and' || CASE WHEN NOT vb THEN '.' WHEN NOT va OR a = b THEN ' [C1].' ELSE ' [C2].' END AS answer FROM v""")
def citation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.filter(X.citation_labels(F.col("answer")), lambda x: x.isin("1", "2", "3", "4"))
    return _labelled(spark, sf_dir).select("conv_id", "turn", X.rewrite_citations(F.col("answer"), valid).alias("answer"))


@query("""SELECT doc_id, coalesce(CASE doc_id % 6 WHEN 0 THEN n_chars WHEN 1 THEN n_chars WHEN 2 THEN -1 WHEN 3 THEN -n_chars ELSE -1 END, -1)::INT AS value, coalesce(n_chars // 4, 0)::INT AS quarter FROM documents""")
def to_int_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, with blanks, with decimals, negative, absent and other text; and numbers with a fraction, which is cut off."""
    c, n = F.col("doc_id") % 6, F.col("n_chars").cast("string")
    raw = F.when(c == 0, n).when(c == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(c == 2, F.concat(n, F.lit(".5"))).when(c == 3, F.concat(F.lit("-"), n)).when(c == 4, "").otherwise(F.col("source"))
    return load(spark, sf_dir, "documents").select("doc_id", X.to_int(raw, -1).alias("value"), X.to_int(F.col("n_chars") / 4).alias("quarter"))


@query()
def rag_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to vectors to cited answers, with the local back ends; questions are the benchmark's texts."""
    store, vectors = pipeline.build_index(documents(spark, sf_dir), chunking=Chunking())
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return pipeline.ask(questions, vectors, store, Retrieval(mode="resume"))
