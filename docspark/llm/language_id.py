"""Language identification: word-first backoff.

A known word scores by its log frequency in each language. A word not known
falls back to its longest character n-grams that are known, progressively
shorter from MAX_GRAM to 1, each step at a discount. Scores add up over the
text's words and become a posterior over the learned languages.

The model is fitted on labelled rows only, on a sample of at most about
``sample_rows`` of them by language (all rows of small languages, equal shares of
the others), and keeps every word and n-gram of the sample as the 64-bit hash of its
characters (XXH64, seed 42; of equal hashes the counts add up) beside a row of small floats, so what is broadcast is bounded by the
sample. A label of which no entry was learned is never
guessed. Prediction reads whole texts; a run of over PIECE letters, as scripts
without spaces have, counts as consecutive words of at most PIECE letters.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is
any text if nothing was learned; a text with letters always gets a learned
language (ties: the first in order); repeated rows are scored alike; an empty
table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import add_by_text, free_name, materialize

SAMPLE_ROWS = 20_000
MAX_GRAM = 5
#: What remains of a word's evidence for each step down to shorter n-grams.
BACKOFF = 0.8
#: Words of a text count up to this many in the posterior's sharpness.
SHARPNESS = 40
UNKNOWN = "und"
# Fixed value: the seed of Spark's xxhash64.
SEED = 42
#: Words that a worker keeps the scores of, and words that it looks up together.
MEMO, PART = 150_000, 16_384
#: Letters of a word at most; what follows is the next word.
PIECE = 64
_WORD = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")

GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


class Logs(NamedTuple):
    """Hashes of tokens in order, and their log frequencies: a row for each token, a column for each language."""

    hashes: np.ndarray
    rows: np.ndarray

    def find(self, tokens: list[str]) -> np.ndarray:
        """The tokens' rows, -1 for those not known."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(t.encode(), SEED) for t in tokens), np.uint64, len(tokens))
        if not len(self.hashes):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


class Model(NamedTuple):
    """Per language log frequencies of words and of n-grams of words (with ends marked)."""

    langs: list[str]
    words: Logs
    grams: Logs

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores of words, kept in ``rows``; words are looked up or backed off when first met, and forgotten when MEMO are kept."""

    def __init__(self, model: Model):
        self.langs, self.words, self.grams = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((MEMO, len(model.langs)), np.float32)

    def _look_up(self, words: list[str]) -> None:
        first = len(self.at)
        self.at.update(zip(words, range(first, first + len(words))))
        rows, found = self.rows[first : first + len(words)], self.words.find(words)
        known = found >= 0
        rows[known], rows[~known] = self.words.rows[found[known]], 0
        left = np.flatnonzero(~known)
        for step, n in enumerate(range(MAX_GRAM, 0, -1)):
            if not len(left):
                break
            marked = [f"^{words[i]}$" for i in left]
            places = self.grams.find([w[i : i + n] for w in marked for i in range(len(w) - n + 1)])
            owners = np.repeat(np.arange(len(left)), [max(len(w) - n + 1, 0) for w in marked])[places >= 0]
            hits = np.bincount(owners, minlength=len(left))
            some = hits > 0
            if some.any():
                starts = np.cumsum(hits[some]) - hits[some]
                sums = np.add.reduceat(self.grams.rows[places[places >= 0]].astype(float), starts, axis=0)
                rows[left[some]] = sums * (BACKOFF ** (step + 1) / hits[some])[:, None]
            left = left[~some]

    def guess(self, text: str | None) -> tuple[str, float]:
        langs = self.langs
        counts = Counter(_WORD.findall(text.lower())) if text and langs else None
        if not counts or not any(map(str.isalpha, counts)) and not any(c.isalpha() for w in counts for c in w):
            return UNKNOWN, 0.0
        best, total, words = np.zeros(len(langs)), 0, list(counts)
        for i in range(0, len(words), PART):  # the whole text, in parts that the memo holds
            part = words[i : i + PART]
            if len(self.at) + len(part) > MEMO:
                self.at.clear()
            if new := [w for w in part if w not in self.at]:
                self._look_up(new)
            n = np.fromiter(map(counts.__getitem__, part), np.float32, len(part))
            best += n @ self.rows[np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))]
            total += n.sum()
        mean = best / total
        p = np.exp((mean - mean.max()) * min(total, SHARPNESS))
        top = int(p.argmax())
        return langs[top], float(p[top] / p.sum())


def _logs(counted: pa.Table, at: list[int]) -> Logs:
    """Smoothed log relative frequencies in the languages ``at``, less their mean over these: what counts is the contrast."""
    hashes = counted["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    counts = np.stack([counted[f"n{i}"].to_numpy() for i in at], axis=1)[order].astype(float)
    log = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(order))))
    return Logs(hashes[order], (log - log.mean(axis=1, keepdims=True)).astype(np.float32))


NOTHING = Model([], *[Logs(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))] * 2)


def row_share(sizes: list[int], sample_rows: int) -> float:
    """The most rows of a language such that all languages together have ``sample_rows`` at most."""
    left = sample_rows
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left / (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on rows of ``labelled`` with a language; the sample goes by a hash of the row's identifier and text."""
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return NOTHING
    share = row_share(list(by_lang.values()), sample_rows)
    if large := [lang for lang in langs if by_lang[lang] > share]:
        most = F.create_map(*[F.lit(x) for lang in large for x in (lang, math.ceil(1_000_000_000 * share / by_lang[lang]))])
        rows = rows.where(F.pmod("h", F.lit(1_000_000_000)) < F.coalesce(F.try_element_at(most, "lang"), F.lit(1_000_000_000)))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{PIECE}}}"), F.lit(0))).alias("token"))
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    counted = materialize(words.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")), "words")
    hashed = lambda df: df.groupBy(F.xxhash64("token").alias("h")).agg(*each).toArrow()
    marked = F.concat(F.lit("^"), "token", F.lit("$"))
    cut = lambda k: F.transform(F.slice(F.sequence(F.lit(1), F.length(marked)), 1, F.greatest(F.length(marked) - k + 1, F.lit(0))), lambda i: F.substring(marked, i, F.lit(k)))
    grams = counted.select("lang", F.explode(F.flatten(F.array(*[cut(k) for k in range(1, MAX_GRAM + 1)]))).alias("token"), "n")
    words, grams = hashed(counted), hashed(grams)
    learned = [i for i in range(len(langs)) if words[f"n{i}"].to_numpy().any()]
    if not learned:
        return NOTHING
    return Model([langs[i] for i in learned], _logs(words, learned), _logs(grams, learned))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with ``out``: (lang, score from 0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = sent.value.scorer()

        def per_batch(texts: pa.Array) -> pa.Array:
            guesses = [scorer.guess(t.as_py()) for t in texts]
            return pa.StructArray.from_arrays([pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64())], fields=list(_ARROW))

        return per_batch

    return add_by_text(docs, text_col, make, GUESS, free_name(docs, out))
