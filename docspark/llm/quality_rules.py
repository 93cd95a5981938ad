"""Quality rules: a text's own repetition, and lines that too many documents of a host share.

A text fails on its own if it is short or if too many of its words lie in five-word windows that the text
holds more than once. Across documents, lines are normalised and hashed, and for each host the distinct documents that hold
a line are counted, equal texts as one document; lines above the limit are removed, and a document that is left
with too little goes. All of it is Column expressions, joins and groupings. What is shuffled are line digests with
word counts, not texts; a document's own windows are compared inside its row.

Defined results: a null text has no words and fails; a null host is a host of its own; lines without a word don't count; rows that repeat an
identifier are documents each; a line that a third of all rows hold is joined by a broadcast (``common.join_counted``), and so is a text;
an empty table gives no rows; other columns are passed on by ``clean``, whatever their names, and not read by ``assess``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.llm.common import ASCII_SPACE, free_name, join_counted, materialize

SYMBOLS, WINDOW = "#*$%&|<>", 5
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Distinct documents of a host that may hold a line; what share of its words a document must keep.
LINE_DOCUMENTS, LEAST_LEFT = 30, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{ASCII_SPACE}+"), "")


def _twins(sorted_: Column, value) -> Column:
    """The elements of a sorted array whose value the one before or after has too."""
    same = lambda a, b: F.coalesce(value(a) == value(b), F.lit(False))
    return F.filter(sorted_, lambda e, i: same(e, F.get(sorted_, i - 1)) | same(e, F.get(sorted_, i + 1)))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many of ``words`` lie in windows of ``size`` words that occur twice or more.

    Windows are hashed first; only those whose hash repeats are compared as they are, by sorting.
    """
    starts = lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
    hashes = lambda w: F.transform(starts(w), lambda _, i: F.xxhash64(F.slice(w, i + 1, F.lit(size))))
    numbered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def exact(w: Column, h: Column) -> Column:
        suspects = let(numbered(h), lambda s: _twins(s, lambda e: e["x"]))
        named = lambda t: F.sort_array(F.transform(t, lambda e: F.struct(F.array_join(F.slice(w, e["i"] + 1, F.lit(size)), " ").alias("x"), e["i"].alias("i"))))
        twins = let(named(suspects), lambda s: _twins(s, lambda e: e["x"]))
        return let(F.sort_array(F.transform(twins, lambda e: e["i"])), covered)

    return let(words, lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w, h))))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def _left_out(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def normalised_lines(text: Column) -> Column:
    """Lines in the form in which they are compared: A-Z lower-cased, numbers as 0, white space as one blank, none at the ends. One for each line of ``text``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.regexp_replace(F.regexp_replace(F.translate(text, upper, lower), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    return F.transform(F.split(folded, "\n", -1), lambda x: F.trim(x))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def measure(docs: DataFrame, text_col: str = "text", host_col: str = "source", out: str = "rules") -> DataFrame:
    """``docs`` with ``out``: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host, content, lines); ``lines``: (digest, words) of lines with a word."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # lines without a word are the empty ones now
    lines = F.transform(F.filter(normalised_lines(text), lambda x: x != ""), lambda x: F.struct(_digest(x).alias("digest"), (_left_out(x, " ") + 1).alias("words")))
    words = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).cast("bigint").alias("repeated")))
    word_chars = (F.length(text) - _left_out(text, SPACES)).cast("bigint")
    rest = {"word_chars": word_chars, "n_symbols": _left_out(text, SYMBOLS).cast("bigint"), "n_dup_lines": _duplicate_lines(text).cast("bigint")}

    def base(w: Column) -> Column:
        failed = (w["n"] < LEAST_WORDS) | (100 * w["repeated"] > MOST_REPEATED * w["n"])
        return F.struct(w["n"].alias("n_words"), *[c.alias(k) for k, c in rest.items()], w["repeated"].alias("n_repeat_words"), failed.alias("base_failed"), F.col(f"`{host_col}`").cast("string").alias("host"), _digest(text).alias("content"), lines.alias("lines"))

    return docs.withColumn(out, let(words, base))


def _lines(measured: DataFrame, out: str) -> DataFrame:
    """(host, content, digest, words): each line of each distinct text of a host once, with all its words there."""
    texts = measured.groupBy(F.col(f"{out}.host").alias("host"), F.col(f"{out}.content").alias("content")).agg(F.first(f"{out}.lines").alias("lines"))
    each = texts.select("host", "content", F.explode("lines").alias("line"))
    return materialize(each.groupBy("host", "content", F.col("line.digest").alias("digest")).agg(F.sum("line.words").alias("words")), "host-lines")


def frequent_lines(lines: DataFrame, most: int = LINE_DOCUMENTS) -> DataFrame:
    """(host, digest, n_documents): lines that over ``most`` distinct documents of a host hold."""
    return lines.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") > most)


def _verdicts(measured: DataFrame, out: str, most: int) -> tuple[DataFrame, str]:
    """``measured`` with the digests and words of its lines that are above the limit, null if it has none, and that column's name."""
    removed, n = free_name(measured, "__removed"), free_name(measured, "__n")
    host, content = free_name(measured, "__host"), free_name(measured, "__content")
    lines = _lines(measured, out)
    often = materialize(frequent_lines(lines, most), "frequent-lines")
    found = join_counted(lines, often, ["host", "digest"], "n_documents", lines.count())
    by_text = found.groupBy("host", "content").agg(F.struct(F.collect_set("digest").alias("digests"), F.sum("words").alias("words")).alias(removed))
    rows = measured.withColumns({host: F.col(f"{out}.host"), content: F.col(f"{out}.content")})
    copies = rows.groupBy(host, content).agg(F.count(F.lit(1)).alias(n))
    same = lambda a: a["host"].eqNullSafe(F.col(host)) & (a["content"] == F.col(content))
    # every text is in, so that the inner join keeps all rows
    groups = materialize(copies.join(by_text, same(by_text), "left").select(host, content, n, removed), "removed-lines")
    return join_counted(rows, groups, [host, content], n, measured.count()).drop(host, content, n), removed


def _judged(rows: DataFrame, out: str, removed: str, least_left: float) -> tuple[Column, Column, Column]:
    """(lines removed, words left, whether the document stays)."""
    rules = F.col(out)
    gone = F.coalesce(F.col(f"{removed}.words"), F.lit(0))
    left = rules["n_words"] - gone
    lines = F.filter(rules["lines"], lambda x: F.array_contains(F.col(f"{removed}.digests"), x["digest"]))
    n_lines = F.when(F.col(removed).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint")
    return n_lines, left, ~rules["base_failed"] & (left >= LEAST_WORDS) & (left >= least_left * rules["n_words"])


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = LINE_DOCUMENTS, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base figures, base_failed, n_lines_removed, n_words_left, kept."""
    measured = measure(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{host_col}`").alias("host")), "text", "host")
    rows, removed = _verdicts(materialize(measured.select("doc_id", "rules"), "text-rules"), "rules", most)
    n_lines, left, kept = _judged(rows, "rules", removed, least_left)
    base = [F.col(f"rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return rows.select("doc_id", *base, n_lines.alias("n_lines_removed"), left.alias("n_words_left"), kept.alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", most: int = LINE_DOCUMENTS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that stay, without the lines above the limit, all other columns as they are."""
    out = free_name(docs, "rules")
    rows, removed = _verdicts(materialize(measure(docs, text_col, host_col, out), "text-rules"), out, most)
    _, _, kept = _judged(rows, out, removed, least_left)
    text = F.col(f"`{text_col}`")
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("raw"), normalised_lines(text).alias("norm"))
    left = F.filter(pairs, lambda p: ~F.array_contains(F.col(f"{removed}.digests"), _digest(p["norm"])))
    cleaned = F.when(F.col(removed).isNull(), text).otherwise(F.array_join(F.transform(left, lambda p: p["raw"]), "\n"))
    return rows.where(kept).withColumn(text_col, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])
