"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, collocations, decontamination, exact_dedup, language_id, pii, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts, vector_codes
from docspark.llm.common import table

TOKEN_LIMIT = 2048


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("email", "ip", "card", "phone")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(pii.span_list(F.col("pii"), base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.col("contamination")
    return found.select("doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), F.size(hit["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"), (hit["n_hit"] > 0).alias("contaminated"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.kd_shards(table(spark, sf_dir, "documents"), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secret_scan.BASE), F.sha2(pii.span_list(F.col("secrets"), secret_scan.BASE), 256).alias("base_sha256"), pii.span_list(F.col("secrets")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("bpe.ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = vector_codes.encode(vectors, books).select("vec_id", "label", "code", "error")
    return vector_codes.add_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_exact_dedup, op4_simhash, op5_decontamination, op6_kd_sharding, op7_secrets, op8_token_counts, op9_bpe, op10_suffix_dedup, op11_vector_codes, op12_collocations, op13_quality_rules)}

_EXACT_DEDUP = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) = 1 AS kept,
  sha256(norm) AS text_sha256
FROM rows
"""

_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce({_WORDS_SQL}, []) AS words FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS words FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item, words, least({decontamination.WINDOW}, len(words)) AS size FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(words[p : p + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM sized)
), places AS (
  SELECT uid, size, p, array_to_string(words[p : p + size - 1], ' ') AS win
  FROM (SELECT uid, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM sized))
), hits AS (
  SELECT uid, p, size, item FROM places JOIN windows USING (size, win)
), covered AS (
  SELECT uid, count(DISTINCT word) AS n FROM (SELECT uid, unnest(range(p, p + size)) AS word FROM (SELECT DISTINCT uid, p, size FROM hits)) GROUP BY uid
), named AS (
  SELECT uid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY uid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (uid) LEFT JOIN named USING (uid)
"""


def _secrets_sql() -> str:
    """Matches and the gaps between them by rule; running sums of both are offsets."""
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.spans.replace("'", "''")
        parts.append(f"SELECT uid, {k} AS k, '{rule.name}' AS kind, {rule.length} AS least, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.measured}) AS measured, string_split_regex(text, '{pattern}') AS g FROM rows WHERE regexp_matches(text, '{pattern}')")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  {" UNION ALL ".join(parts)}
), each AS (
  SELECT uid, k, kind, least, i, length(m[i]) AS n, length(g[i]) AS gap, length(measured[i]) AS size
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
), placed AS (
  SELECT *, sum(gap + n) OVER (PARTITION BY uid, k ORDER BY i) AS last FROM each
), spans AS (
  SELECT uid, k, kind, last - n AS first, kind || ':' || (last - n)::BIGINT || ':' || last::BIGINT AS span FROM placed WHERE size >= least
), listed AS (
  SELECT uid, {counts}, string_agg(span, ',' ORDER BY first, k) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY first, k) AS spans FROM spans GROUP BY uid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN listed USING (uid)
"""


def _vector_codes_sql() -> str:
    """The rounds one after another, on one row for each part component."""
    v = vector_codes
    mean = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    tables = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT uid, (i - 1) // (len(e) // {v.PARTS}) AS p, (i - 1) % (len(e) // {v.PARTS}) AS i, floor({v.SCALE} * e[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT uid, e, unnest(range(1, len(e) + 1)) AS i FROM kept)
), first AS (
  SELECT uid, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM kept ORDER BY vec_id LIMIT {v.ENTRIES}
), b0 AS MATERIALIZED (
  SELECT p, c, i, x FROM parts JOIN first USING (uid)
)"""]
    for k in range(v.ROUNDS + 1):
        tables.append(f"""d{k} AS MATERIALIZED (
  SELECT uid, p, c, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM parts a JOIN b{k} b USING (p, i) GROUP BY ALL
), a{k} AS MATERIALIZED (
  SELECT uid, p, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY uid, p ORDER BY d, c) = 1
)""")
        if k < v.ROUNDS:
            tables.append(f"""m{k} AS (SELECT p, c, i, {mean} AS x FROM parts JOIN a{k} USING (uid, p) GROUP BY p, c, i
), b{k + 1} AS MATERIALIZED (
  SELECT p, c, i, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, c, i)
)""")
    last = v.ROUNDS
    return "WITH " + ", ".join(tables) + f""", coded AS (
  SELECT uid, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY uid
), books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM b{last}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (uid), books
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _collocations_sql() -> str:
    c = collocations
    grams = " UNION ALL ".join(f"SELECT lang, w, {n} AS len, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i : i + {n - 1}], ' '))) AS phrase FROM pieces" for n in range(1, c.LONGEST + 1))
    inside = " UNION ALL ".join(f"SELECT lang, a, unnest(list_transform(range(1, len - {n - 2}), lambda i: array_to_string(ws[i : i + {n - 1}], ' '))) AS phrase FROM candidates WHERE len > {n}" for n in range(2, c.LONGEST))
    return f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws, count(*) AS w FROM cut GROUP BY lang, piece
), counts AS MATERIALIZED (
  SELECT lang, len, phrase, sum(w) AS f FROM ({grams}) GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE len > 1 AND f >= {c.LEAST}
), cuts AS MATERIALIZED (
  SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates)
), heads AS MATERIALIZED (
  SELECT c.*, x.f AS l FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
), scored AS (
  SELECT c.lang, c.phrase, k, a, l, x.f AS r, (1000000 * a * a) // (l * x.f) AS score FROM heads c JOIN counts x ON x.lang = c.lang AND x.phrase = c.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), absorbed AS (
  SELECT lang, phrase, max(a) AS over FROM ({inside}) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN absorbed USING (lang, phrase) WHERE over IS NULL OR 100 * over < {c.ABSORBED} * a
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE len = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {c.TOP}
"""


def _quality_sql() -> str:
    q = quality_rules
    norm = f"trim(regexp_replace(regexp_replace({_LOWERED.replace('text', 'line')}, '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ')".replace("\\\\", "\\")
    return f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT uid, i, array_to_string(ws[i : i + {q.WINDOW - 1}], ' ') AS win FROM (SELECT uid, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM rows)
), twice AS (
  SELECT uid, i FROM windows QUALIFY count(*) OVER (PARTITION BY uid, win) > 1
), repeated AS (
  SELECT uid, count(DISTINCT w) AS n FROM (SELECT uid, unnest(range(i, i + {q.WINDOW})) AS w FROM twice) GROUP BY uid
), lines AS MATERIALIZED (
  SELECT uid, host, text, line, {norm} AS norm FROM (SELECT uid, host, text, unnest(string_split(text, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), own AS (
  SELECT uid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY uid
), often AS (
  SELECT host, norm FROM (SELECT DISTINCT host, text, norm FROM lines) GROUP BY host, norm HAVING count(*) > {q.LINE_DOCUMENTS}
), gone AS (
  SELECT uid, count(*) AS n, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM lines l JOIN often o ON o.norm = l.norm AND o.host IS NOT DISTINCT FROM l.host GROUP BY uid
), base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(own.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_lines_removed, (len(ws) - coalesce(gone.words, 0))::BIGINT AS n_words_left
  FROM rows LEFT JOIN own USING (uid) LEFT JOIN repeated USING (uid) LEFT JOIN gone USING (uid)
)
SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words) AND n_words_left >= {q.LEAST_WORDS} AND n_words_left >= {q.LEAST_LEFT} * n_words AS kept
FROM base
"""


#: The other operators: XXH64 fingerprints and components, tokenizers, a learned model, a k-d tree and byte-wise matching have no
#: SQL that runs on whole tables; PII's checksums and context have none that is plainer than the operator. Tests use brute force.
ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": _EXACT_DEDUP, "op5_decontamination": _DECONTAMINATION, "op7_secrets": _secrets_sql(), "op11_vector_codes": _vector_codes_sql(), "op12_collocations": _collocations_sql(), "op13_quality_rules": _quality_sql()}
