"""A corpus pipeline from five training-data operators.

Each stage takes (spark, docs, sf_dir) and gives what it keeps of ``docs``, all but the
last with the columns of ``docs``. ``run`` writes every stage's rows as Parquet to
the shared folder and reads them as the next one's input.

Defined results: a null text, or one without letters, is of no known language and goes with the first stage;
of rows that repeat identifier and text one stays; a null identifier stays, unless its text has a row with one; an empty table gives no rows; further
columns (of any name) pass all stages but the last, which needs ``lang`` and ``source``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import storage
from docspark.llm import bpe, decontamination, exact_dedup, language_id, near_copies
from docspark.llm.common import free_name, materialize, scratch, table

#: A language is accepted if the model gives it at least this posterior.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = free_name(docs, "language")
    found = language_id.identify(docs, language_id.train(docs.where(~held_out)), out=out)
    known = (F.col(f"{out}.lang") != language_id.UNKNOWN) & (F.col(f"{out}.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).drop(out)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (0.8 or more of their five-word shingles in common) its smallest document stays; rows without an identifier stay."""
    found = near_copies.near_copies(docs)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go."""
    clean = decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian 32-bit) and whether they decode to the text."""
    docs = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "lang", "source", (F.octet_length("bpe.ids") / 4).cast("bigint").alias("n_tokens"), "bpe.ids", (F.col("bpe.decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe", encode_bpe),
]

#: XXH64 fingerprints, components and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the rows of the stage before, are deleted once its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            last = paths.pop()
        if before:
            storage.delete(spark, before)
        before = last
    return docs
