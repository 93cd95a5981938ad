"""Token counts by a digest cache.

A text's normalised content and the tokenizer's file each have a digest; the pair
is the key of a stored count. Only distinct texts that the cache misses are encoded,
and their counts are appended to it. Where the tokenizer's file says that it folds
white space (FOLDING), normalising folds runs of ASCII white space too, which changes no count;
texts for other tokenizers are keyed as they are and given to the library whole.

Within a miss, counting goes by distinct words: a tokenizer of this kind cuts a
text into words first and merges inside each, so a text's count is the sum of its
words' counts, and the library merges each word once. That holds for texts of
plain letters (ASCII, Latin-1, Latin Extended-A); any other text, and any with
special strings, is given to the library whole.

Defined results: a null text counts as empty and has no tokens; equal texts, ties
and repeated rows share a count; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, materialize, shared_dir

#: Words whose counts a worker keeps.
MEMO = 400_000
#: Texts that hold nothing else may be counted by words. The tokenizer's own word pattern over them.
PLAIN = "\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r\x20"
#: The normaliser and word cutter of a tokenizer file for which folding and counting by words hold.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_ODD = re.compile(f"[^{PLAIN}]|<\\|")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")


@lru_cache(maxsize=2)
def _tokenizer(data: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else the next free one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


_BYTE_LETTERS = dict(enumerate(byte_letters()))


class Counter:
    """Counts the tokens of texts; keeps the counts of words."""

    def __init__(self, data: str, by_words: bool = True):
        self.tokenizer, self.by_words, self.memo = _tokenizer(data), by_words, {}

    def count(self, texts: list[str]) -> list[int]:
        memo, out, later, merge, letters = self.memo, [0] * len(texts), [], self.tokenizer.model.tokenize, _BYTE_LETTERS
        for i, text in enumerate(texts):
            if not self.by_words or _ODD.search(text):
                later.append(i)
                continue
            words = _WORDS.findall(text.lower())
            if missing := list({w for w in words if w not in memo}):
                if len(memo) > MEMO:
                    memo.clear()
                    missing = list(set(words))
                for w in missing:
                    memo[w] = len(merge(w.encode().decode("latin-1").translate(letters)))
            out[i] = sum(map(memo.__getitem__, words))
        for i in later:
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cache_dir: str | None = None, by_words: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens. ``cache_dir``: where counts are kept from run to run."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    version = hashlib.sha256(data).hexdigest()
    sent = spark.sparkContext.broadcast(data.decode())  # of the tokenizer's fixed size
    spec = json.loads(data)
    folds = spec["normalizer"] == FOLDING
    by_words = by_words and folds and spec["pre_tokenizer"] == CUTTING and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    cache_dir = cache_dir or shared_dir(spark, "token-counts")
    schema = "text_digest binary, n_tokens bigint, tokenizer string"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    folded = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if folds else text
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), folded.alias("folded"))
    rows = rows.withColumn("text_digest", F.unhex(F.sha2("folded", 256)))
    misses = rows.select("text_digest", "folded")
    known = _read(spark, cache_dir, schema, version)
    if known is not None:
        misses = misses.join(known, "text_digest", "left_anti")
    misses = misses.dropDuplicates(["text_digest"])

    def run(batches):
        counter = Counter(sent.value, by_words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())], ["text_digest", "n_tokens"])

    encoded = arrow_map(misses, run, "text_digest binary, n_tokens bigint")
    encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)
    counts = _read(spark, cache_dir, schema, version)
    # runs at the same time may have appended a digest twice, with the same count
    counts = materialize(counts.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-count-of-digest")
    return rows.drop("folded").join(counts, "text_digest").select("doc_id", "n_bytes", "n_tokens")


def _read(spark, cache_dir: str, schema: str, version: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(cache_dir).where(F.col("tokenizer") == version).drop("tokenizer")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
