"""Pluggable back ends: embedding, generation, and calls with retries."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import logging
import math
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import storage
from docspark.config import Prompts
from docspark.functions.arrow import bounded, released
from docspark.operators.answers import SENTINEL

# HTTP statuses and error names after which a call is tried again.
RETRY_STATUS = (408, 409, 429)
RETRY_NAMES = ("APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError")
# The remote library and its client class.
LIBRARY, CLIENT = "openai", "OpenAI"


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, question: str, context: str) -> str: ...


class HashEmbedder:
    """Deterministic and local: signed hashing of words into ``width`` buckets, unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.width] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


class EchoGenerator:
    """Deterministic and local: cites the first passage."""

    def generate(self, question: str, context: str) -> str:
        return json.dumps({"answer": f"See {context.split(maxsplit=1)[0]}.", "citation_ids": []})


def status_of(error: Exception) -> int | None:
    """The HTTP status that an error, or the response it carries, names as a number."""
    found = (getattr(x, "status_code", None) for x in (error, getattr(error, "response", None)))
    return next((s for s in found if isinstance(s, int) and not isinstance(s, bool)), None)


def asked_delay(error: Exception) -> float | None:
    """Seconds that the response's Retry-After header (in any case) asks to wait, at least 0; None if it has no number."""
    headers = getattr(getattr(error, "response", None), "headers", None)
    said = {str(k).lower(): v for k, v in headers.items()} if isinstance(headers, Mapping) else {}
    try:
        seconds = float(said["retry-after"])
    except (KeyError, TypeError, ValueError):
        return None
    return max(seconds, 0.0) if math.isfinite(seconds) else None


def retry_rule(error: Exception) -> tuple[bool, float | None, str]:
    """Whether to call again, the delay the server asks for, and what the error is called in logs."""
    status = status_of(error)
    if status is None or not 400 <= status <= 599:
        name = type(error).__name__
        return name in RETRY_NAMES, None, name
    return status in RETRY_STATUS or status >= 500, asked_delay(error) if status == 429 else None, f"http_{status}"


def with_retries(call: Callable, max_retries: int = 5, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep, label: str = "call", log: logging.Logger | None = None):
    """``call``'s result; after an error that may pass it is called again, up to ``max_retries`` times, waiting as asked or twice as long each time."""
    delays = (base_delay * 2**n for n in range(max_retries))
    while True:
        try:
            return call()
        except Exception as error:
            again, asked, reason = retry_rule(error)
            wait = next(delays, None) if again else None
            if log:
                log.log(logging.ERROR if wait is None else logging.WARNING, "%s: %s, %s", label, reason, "given up" if wait is None else "called again")
            if wait is None:
                raise
            sleep(wait if asked is None else asked)


def embed_texts(rows: DataFrame, make: Callable[[], Embedder], text_col: str = "text", batch_size: int = 64, max_retries: int = 5, base_delay: float = 1.0, pause: float = 0.0) -> DataFrame:
    """``rows`` with ``embedding``; requests of ``batch_size`` texts, ``pause`` seconds apart in a task, the client made once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in frames:
            vectors: list[list[float]] = []
            for i in range(0, len(pdf), batch_size):
                texts = pdf[text_col].iloc[i : i + batch_size].tolist()
                got = with_retries(lambda texts=texts: client.embed(texts), max_retries, base_delay)
                time.sleep(pause)
                if len(got) != len(texts):
                    raise RuntimeError(f"{len(got)} embeddings for {len(texts)} texts")
                vectors += got
            yield pdf.assign(embedding=vectors)

    return bounded(rows).mapInPandas(released(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, embedding array<float>")


def parse_answer(reply: str) -> str:
    """The reply's answer; anything but an object with answer and citation_ids is an error."""
    try:
        data = json.loads(reply)
    except ValueError as e:
        raise RuntimeError("the reply is not JSON") from e
    if not isinstance(data, dict) or not {"answer", "citation_ids"} <= data.keys():
        raise RuntimeError("the reply lacks answer or citation_ids")
    return data["answer"]


#: Fixed value: the JSON schema that a reply must have.
REPLY_SCHEMA = {"type": "object", "properties": {"answer": {"type": "string"}, "citation_ids": {"type": "array", "items": {"type": "string"}}}, "required": ["answer", "citation_ids"], "additionalProperties": False}


@dataclass
class Remote:
    """A model behind a client that is made at the first call, in the worker that calls: only settings travel with a job.

    ``connect`` makes the client from (key, timeout); by default that of an installed library.
    """

    model: str
    key: str = ""
    timeout: float = 60.0
    connect: Callable | None = None

    @property
    def client(self):
        if "_client" not in self.__dict__:
            self.__dict__["_client"] = (self.connect or _library_client)(self.key, self.timeout)
        return self.__dict__["_client"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_client"}


class RemoteEmbedder(Remote):
    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        rows = self.client.embeddings.create(model=self.model, input=texts).data
        vectors = [list(map(float, getattr(r, "embedding", None) or ())) for r in sorted(rows, key=lambda r: getattr(r, "index", 0))]
        if not all(vectors):
            raise RuntimeError("the reply holds no embedding")
        return vectors


class RemoteGenerator(Remote):
    """Asks for replies of REPLY_SCHEMA."""

    def generate(self, question: str, context: str) -> str:
        form = {"type": "json_schema", "name": "cited_answer", "strict": True, "schema": REPLY_SCHEMA}
        prompts = Prompts()
        asked = f"{prompts.before}{question}{prompts.after}\n{context}\n{prompts.closing}"
        reply = self.client.responses.create(model=self.model, input=[{"role": "system", "content": prompts.system}, {"role": "user", "content": asked}], text={"format": form})
        text = getattr(reply, "output_text", None) or "".join(getattr(c, "text", "") for o in getattr(reply, "output", None) or () for c in getattr(o, "content", None) or ())
        if not text.strip():
            raise RuntimeError("the reply is empty")
        return text


def _library_client(key: str, timeout: float):
    """The client class of the remote library, where it is installed and a key is given."""
    if not key.strip():
        raise RuntimeError("the API key is missing")
    if importlib.util.find_spec(LIBRARY) is None:
        raise RuntimeError(f"{LIBRARY} is not installed")
    kind = getattr(importlib.import_module(LIBRARY), CLIENT)
    return kind(api_key=key, timeout=timeout)


#: Requests that one wave of ``embed_once`` sends before their replies are kept.
WAVE = 10_000


def embed_once(rows: DataFrame, make: Callable[[], Embedder], ledger: str, model: str, text_col: str = "text", batch_size: int = 64, max_retries: int = 5, base_delay: float = 1.0, wave: int = WAVE, pause: float = 0.0) -> DataFrame:
    """``rows`` with ``embedding``, each distinct text paid for once, over runs and failures.

    Replies are kept in the ``ledger``, a table by model and digest of the text. What it lacks is asked for in waves of about ``wave`` texts,
    and a wave's replies are in the ledger before the next begins: a run that is lost, executors or driver,
    pays again for one wave at most. A task makes one call at a time, ``pause`` seconds apart.
    """
    spark = rows.sparkSession
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    schema = "digest binary, embedding array<float>, model string"
    storage.make_dir(spark, ledger)
    kept = lambda: spark.read.schema(schema).parquet(ledger).where(F.col("model") == model).select("digest", "embedding")
    texts = rows.select(digest.alias("digest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).dropDuplicates(["digest"])
    missing = storage.materialize(texts.join(kept().select("digest"), "digest", "left_anti"), "texts-to-embed")
    waves = -(-missing.count() // wave)
    for w in range(waves):
        part = missing.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == w)
        done = embed_texts(part, make, "text", batch_size, max_retries, base_delay, pause)
        done.select("digest", "embedding", F.lit(model).alias("model")).write.mode("append").partitionBy("model").parquet(ledger)
    # two runs at once may have kept a digest twice
    replies = kept().groupBy("digest").agg(F.first("embedding").alias("embedding"))
    return rows.withColumn("_digest", digest).join(replies.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")


def generate_answers(questions: DataFrame, context: DataFrame, make: Callable[[], Generator], max_retries: int = 5, base_delay: float = 1.0) -> DataFrame:
    """``questions`` (qid, question), ``context`` (qid, rank, block): (qid, answer); without context the sentinel, and no call."""
    blocks = context.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in frames:
            replies = [parse_answer(with_retries(lambda q=q, c=c: client.generate(q, c), max_retries, base_delay)) if c else SENTINEL for q, c in zip(pdf["question"], pdf["context"])]
            yield pd.DataFrame({"qid": pdf["qid"], "answer": replies})

    kind = dict(questions.dtypes)["qid"]
    asked = questions.join(blocks, "qid", "left").select("qid", "question", "context")
    return bounded(asked).mapInPandas(released(run), f"qid {kind}, answer string")
