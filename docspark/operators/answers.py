"""From generated text to a validated, renumbered answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as X

SENTINEL = "UNKNOWN"
NO_SOURCE = "No passage of the corpus answers this question."

#: A passage as answers show it: name, type, and its column in the context.
_SHOWN = [
    ("origin", "string", "origin"), ("chunk_id", "string", "chunk_id"), ("source_id", "string", "source_id"), ("nature", "string", "nature"), ("path", "string", "origin_path"), ("filename", "string", "filename"),
    ("ext", "string", "ext"), ("unit_type", "string", "unit_type_start"),
]
#: Present only where they have a value.
_OPTIONAL = [("unit_index_end", "int"), ("unit_type_end", "string"), ("char_start", "int"), ("char_end", "int")]
#: Of passages that were found, and of those that expansion added.
_FOUND = [("score", "score"), ("retrieval_score", "retrieval_score"), ("retrieval_distance", "distance")]


def passages(context: DataFrame) -> DataFrame:
    """(qid, blocks): each query's passages in order, as (label, expanded_from, passage: what answers show of it).

    Columns that ``context`` lacks count as empty. Scores are those of found passages, rounded to 6 digits.
    """

    def have(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in context.columns else F.lit(None).cast(kind)

    found = have("origin", "string") == "seed"
    fields = [F.coalesce(have(c, kind), F.lit("")).alias(name) for name, kind, c in _SHOWN]
    fields.append(X.to_int(have("unit_index_start", "string")).alias("unit_index"))
    fields += [(F.nullif(have(name, kind), F.lit("")) if kind == "string" else have(name, kind)).alias(name) for name, kind in _OPTIONAL]
    fields += [F.when(found, F.round(have(c, "double"), 6)).alias(name) for name, c in _FOUND]
    fields.append(F.when(~found, have("expanded_depth", "int")).alias("expanded_depth"))
    block = F.struct(F.col("rank").alias("rank"), F.col("rank").cast("string").alias("label"), F.when(~found, have("expanded_from", "string")).alias("from"), F.struct(*fields).alias("passage"))
    return context.groupBy("qid").agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def finish(answers: DataFrame, context: DataFrame) -> DataFrame:
    """``answers`` (qid, answer) and ``context`` (qid, rank, chunk_id, origin, ...): qid, answer, citations, used_chunks.

    Labels outside the context vanish, the rest are renumbered by first appearance. ``citations`` are
    the cited passages, ``used_chunks`` the whole context; a passage that expansion added names the label of the one it came from, if that is
    cited. No valid label, or the sentinel, gives the no-source answer, without citations and chunks.
    """
    rows = answers.join(passages(context), "qid", "left").withColumn("blocks", F.coalesce("blocks", F.array()))
    known = F.transform("blocks", lambda x: x["label"])
    rows = rows.withColumn("valid", F.filter(X.citation_labels(F.col("answer")), lambda label: F.array_contains(known, label)))
    ok = (X.strip(F.col("answer")) != SENTINEL) & (F.size("valid") > 0)
    cited = F.transform("valid", lambda label: F.element_at(F.filter("blocks", lambda x: x["label"] == label), 1))
    rows = rows.withColumn("cited", cited).withColumn("names", F.transform("cited", lambda x: x["passage"]["chunk_id"]))

    def show(x: Column, label: Column | None = None) -> Column:
        at = F.array_position("names", x["from"])
        origin = F.when(at > 0, F.concat(F.lit("C"), at.cast("string"))).alias("expanded_from_label")
        own = [] if label is None else [label.alias("label")]
        return F.struct(*own, *[x["passage"][name].alias(name) for name in SHOWN_FIELDS], origin)

    citations = F.transform("cited", lambda x, i: show(x, F.concat(F.lit("C"), (i + 1).cast("string"))))
    used = F.transform("blocks", lambda x: show(x))
    none = lambda a: F.when(ok, a).otherwise(F.slice(a, 1, 0))
    return rows.select("qid", F.when(ok, X.rewrite_citations(X.strip(F.col("answer")), F.col("valid"))).otherwise(NO_SOURCE).alias("answer"), none(citations).alias("citations"), none(used).alias("used_chunks"))


SHOWN_FIELDS = [*[name for name, _, _ in _SHOWN], "unit_index", *[name for name, _ in _OPTIONAL], *[name for name, _ in _FOUND], "expanded_depth"]


def as_json(rows: DataFrame, questions: DataFrame, mode: str, model: str, pretty: bool = True) -> DataFrame:
    """(qid, json): query, mode, model, answer, citations, used_chunks and generated_at (UTC); what has no value is left out."""
    full = rows.join(questions.select("qid", F.col("question").alias("query")), "qid")
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return full.select("qid", F.to_json(F.struct("query", F.lit(mode).alias("mode"), F.lit(model).alias("model"), "answer", "citations", "used_chunks", when.alias("generated_at")), {"pretty": str(pretty).lower()}).alias("json"))
