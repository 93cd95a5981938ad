"""Phrases whose words occur together more often than chance, by language.

Texts are cut into pieces, and identical pieces of a language become one with a multiplicity. Workers
turn batches of pieces into n-grams with weights, by arithmetic on word numbers, and send them
in blocks to hash buckets; each bucket is counted in its own task by duckdb, which
works out of core: it spills to the task's own scratch folder, which no other task reads and which goes with the task.
Every bucket keeps what may be a candidate or part of one, and its words' total.

A candidate's parts lie in other buckets. Candidates of a bucket ask for each part once, requests
are shuffled to the parts' counts and the answers back to the bucket, so a part that a third
of all candidates hold is asked for once a bucket and joined in as many places.

Defined results: a null text counts as empty, a null language as ``und``; white space other than blank and tab
belongs to words, if it isn't a cut; repeated rows and equal texts count as often as they are there; equal scores are told apart by count, then
by the phrase's bytes; an empty table gives no rows; other columns are not read. Counts pass 64 bits nowhere below 10 ** 16 occurrences of a phrase.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, materialize

#: Where texts are cut into pieces; what separates words.
CUTS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST, LEAST, ABSORBED, TOP = 3, 10, 50, 2000
#: Words whose n-grams a worker adds up before it sends them.
BLOCK_WORDS = 500_000
#: Memory of a bucket's count; beyond it duckdb spills.
MEMORY = "192MB"
#: Candidates of a language that are ranked together: parts of so many are cut to the best until one part is left.
RANKED = 16_000


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, weight): distinct pieces of a language, words apart by one blank, and how often each occurs."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    cut = F.explode(F.split(F.regexp_replace(text, BLANKS, " "), f" ?{CUTS} ?"))
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), cut.alias("piece"))
    return rows.withColumn("piece", F.trim("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("weight"))


def _encoded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key among the distinct ones, the distinct keys)."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def ngrams(langs: pa.Array, texts: pa.Array, weights: np.ndarray, longest: int, buckets: int) -> pa.RecordBatch:
    """The weighted n-grams of a batch of pieces, in one row for each bucket and language: (bucket, lang, phrases joined by newlines, weights), both compressed."""
    cut = pc.split_pattern(texts, " ")
    words = cut.flatten().dictionary_encode()
    spoken = langs.dictionary_encode()
    vocabulary, word, names = words.dictionary, words.indices.to_numpy().astype(np.int64), spoken.dictionary
    piece = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    hashes = lambda a: pd.util.hash_array(a.to_numpy(zero_copy_only=False), categorize=False)
    of_word, size = hashes(vocabulary), len(vocabulary)
    # a word's n-gram is known by its number; prefix, last word, language and hash are kept for each number
    at = np.arange(len(word))
    group, keys = _encoded(spoken.indices.to_numpy()[piece].astype(np.int64) * size + word)
    lang, last = keys // size, keys % size
    hashed, phrase = hashes(names)[lang] * np.uint64(0x9E3779B97F4A7C15) ^ of_word[last], vocabulary.take(pa.array(last))
    out = []
    for n in range(1, longest + 1):
        if n > 1:
            follows = at[(at + n - 1 < len(word))]
            follows = follows[piece[follows] == piece[np.minimum(follows + n - 1, len(word) - 1)]]
            # group is by position among the starts of (n-1)-grams
            group, keys = _encoded(group[np.searchsorted(at, follows)].astype(np.int64) * size + word[follows + n - 1])
            before, last, at = keys // size, keys % size, follows
            lang, phrase = lang[before], pc.binary_join_element_wise(phrase.take(pa.array(before)), vocabulary.take(pa.array(last)), " ")
            hashed = (hashed[before] ^ (hashed[before] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + of_word[last]
        # sums of whole numbers, exact in double precision below 2 ** 53
        out.append((lang, hashed, phrase, np.bincount(group, weights=weights[piece[at]], minlength=len(keys)).astype(np.int64)))
    lang, hashed, weight = (np.concatenate([o[i] for o in out]) for i in (0, 1, 3))
    mixed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    key = bucket * len(names) + lang
    order = np.argsort(key, kind="stable")
    key, phrase = key[order], pa.concat_arrays([o[2] for o in out]).take(pa.array(order))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    bounds = np.r_[starts, len(key)]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), phrase), "\n")
    packed, sent, press = weight[order].astype("<i8").tobytes(), key[starts], zstandard.ZstdCompressor(level=1).compress
    phrases = pa.array([press(x.as_buffer()) for x in joined.cast(pa.binary())], pa.binary())
    weights = pa.array([press(packed[8 * a : 8 * b]) for a, b in zip(bounds, bounds[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array((sent // len(names)).astype(np.int32)), names.take(pa.array(sent % len(names))), phrases, weights], ["bucket", "lang", "phrases", "weights"])


def _send(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            column = lambda i: rows.column(i).chunk(0)
            return ngrams(column(0).cast(pa.string()), column(1).cast(pa.string()), column(2).to_numpy(), longest, buckets)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += pc.sum(pc.count_substring(batch.column(1), " ")).as_py() + batch.num_rows
            if size >= BLOCK_WORDS:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return run


def _count(least: int):
    """Counts the n-grams of the buckets that a task gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        unpress = zstandard.ZstdDecompressor().decompress
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(f"{scratch}/bucket.db", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as db:
            db.execute("CREATE TABLE sent (lang VARCHAR, phrase VARCHAR, weight BIGINT)")
            for batch in batches:
                phrases, weights = ([unpress(x.as_buffer()) for x in batch.column(i)] for i in (2, 3))
                parts = pc.split_pattern(pa.array(phrases, pa.binary()).cast(pa.string()), "\n")
                of = np.repeat(np.arange(len(batch)), np.diff(parts.offsets.to_numpy()))
                weight = np.frombuffer(b"".join(weights), "<i8")
                rows = pa.table({"lang": batch.column(1).cast(pa.string()).take(pa.array(of)), "phrase": parts.flatten(), "weight": weight})  # noqa: F841 (duckdb finds it by name)
                db.execute("INSERT INTO sent SELECT * FROM rows")
            counted = db.sql(f"SELECT lang, phrase, sum(weight)::BIGINT AS n FROM sent GROUP BY ALL HAVING sum(weight) >= {int(least)} UNION ALL SELECT lang, NULL, sum(weight)::BIGINT FROM sent WHERE NOT contains(phrase, ' ') GROUP BY ALL")
            for batch in counted.to_arrow_reader(10_000):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

    return run


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None) -> DataFrame:
    """(lang, phrase, n): all phrases of up to ``longest`` words that occur ``least`` times or more; rows without a phrase hold word totals, to be added up."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = arrow_map(pieces(docs, text_col, lang_col), _send(buckets, longest), "bucket int, lang string, phrases binary, weights binary")
    counted = arrow_map(blocks.repartitionById(buckets, F.col("bucket")), _count(least), "lang string, phrase string, n bigint")
    return materialize(counted, "phrase-counts")


def _sub(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _score(counted: DataFrame, buckets: int) -> DataFrame:
    """(lang, phrase, a, score, l, r): candidates with their lowest cut, parts looked up by requests."""
    words = F.split("phrase", " ")
    candidates = counted.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("n").alias("a"), F.pmod(F.xxhash64("lang", "phrase"), F.lit(buckets)).alias("home"), words.alias("words"))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "home", "words", k).select("lang", "phrase", "a", "home", "k", _sub(F.col("words"), F.lit(1), F.col("k")).alias("left"), _sub(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    requests = cuts.select("home", "lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    answers = materialize(requests.join(counted.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]), "phrase-parts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(answers.select("home", "lang", F.col("part").alias(side), F.col("n").alias(name)), ["home", "lang", side])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("bottom", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")


def _absorbed(counted: DataFrame, longest: int, share: int) -> DataFrame:
    """(lang, phrase, over): the greatest count of a longer candidate that holds the phrase's words in a row."""
    held = counted.where(F.size(F.split("phrase", " ")) > 2).select("lang", "n", F.split("phrase", " ").alias("words"))
    words, none = F.col("words"), F.array().cast("array<string>")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: _sub(words, i, F.lit(n)))
    shorter = F.flatten(F.array(none, *[F.when(F.size(words) > n, runs(n)).otherwise(none) for n in range(2, longest)]))
    return held.select("lang", "n", F.explode(shorter).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("over"))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank. Parts of a language are cut to ``top`` each, and what is left again, so that no task sorts a whole one."""
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    rows = materialize(rows, "phrase-scores")
    size = max(RANKED, 4 * top)
    n, before = rows.count(), None
    while n > size and (before is None or n < before):
        cut = rows.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(1 + n // size)))
        rows = materialize(cut.withColumn("place", place("lang", "dealt")).where(F.col("place") <= top).drop("dealt", "place"), "phrase-scores")
        n, before = rows.count(), n
    return rows.withColumn("rank", place("lang").cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a (its count), l, r (counts of its parts), n (the language's words), score."""
    counts = count_phrases(docs, longest, least, text_col, lang_col, buckets)
    counted, totals = counts.where("phrase IS NOT NULL"), counts.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = _score(counted, buckets).join(_absorbed(counted, longest, absorbed), ["lang", "phrase"], "left")
    kept = scored.where(F.col("over").isNull() | (F.col("over").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * absorbed)).drop("over")
    return _ranked(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
