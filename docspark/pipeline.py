"""End to end: ingest documents into chunks and vectors, and answer a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.config import Chunking, Indexing, Retrieval, config_hash
from docspark.operators import answers, index, retrieval
from docspark.operators.chunking import chunk
from docspark.sources.connectors import EchoGenerator, Embedder, Generator, HashEmbedder, embed_texts, generate_answers
from docspark.storage import materialize


def build_index(docs: DataFrame, existing: DataFrame | None = None, make: Callable[[], Embedder] = HashEmbedder, chunking: Chunking = Chunking(), indexing: Indexing = Indexing(), sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk store, next index snapshot) of ``docs`` (source_id, text, units): only chunks that ``existing`` lacks are embedded.

    ``sources`` (source_id, filename, nature, ext, ...) gives the metadata by which searches filter and citations name documents.
    Rows that repeat a source: the last in order of text counts.
    """
    store = chunk(docs, chunking)
    if sources is not None:
        store = store.join(sources.select("source_id", *[c for c in index.TEXT_FIELDS if c in sources.columns and c not in store.columns]), "source_id", "left")
    store = materialize(store, "chunks")
    desired = index.last_wins(index.flatten(store.where("level = 'leaf'"), model=indexing.model), "text").withColumn("config", F.lit(config_hash(indexing)))
    todo = desired if existing is None else desired.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    new = embed_texts(todo.select("chunk_id", "text"), make, batch_size=indexing.batch_size, max_retries=indexing.max_retries, base_delay=indexing.base_delay)
    if existing is None:
        return store, materialize(desired.join(new.select("chunk_id", "embedding"), "chunk_id"), "vectors")
    return store, materialize(index.merge(existing, desired, new), "vectors")


def ask(questions: DataFrame, vectors: DataFrame, store: DataFrame, config: Retrieval = Retrieval(), make: Callable[[], Embedder] = HashEmbedder, generator: Callable[[], Generator] = EchoGenerator) -> DataFrame:
    """``questions`` (qid, question): answers with citations and the chunks used."""
    queries = materialize(embed_texts(questions, make, text_col="question").select("qid", "question", F.col("embedding").alias("query")), "questions")
    context = materialize(retrieval.retrieve(queries, vectors, store, config), "context")
    return answers.finish(generate_answers(questions, context, generator), context)
