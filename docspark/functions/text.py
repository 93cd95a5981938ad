"""Text scalars as Column expressions (code points throughout)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.arrow import give_back
from docspark.functions.spans import WHITE_SPACE, word_places

#: Characters of texts that are looked at together (one text at least).
_AT_ONCE = 250_000
_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def normalize(text: Column) -> Column:
    """One newline kind, no control characters or no-break spaces, lines stripped, runs of blank lines folded to one."""
    steps = [
        (r"\r\n|\r|\x0B", "\n"), (r" ", " "), (r"[\x00-\x08\x0C\x0E-\x1F\x7F]", " "),
        (r"(?mdU)^[^\S\n]+|[^\S\n]+$", ""), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", ""),
    ]
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def normalize_line(text: Column) -> Column:
    """``normalize`` of a text that is mostly clean: one look tells whether any of its steps has something to do."""
    untidy = r"[\x00-\x08\x0B-\x1F\x7F\xA0]|(?U:^\s|\s$|\s\n|\n\s)"
    return F.when(text.rlike(untidy), normalize(text)).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))


_BLOCK = 32
#: Levels of blocks: up to _BLOCK ** (levels + 1) elements every block is short, beyond that the topmost grows.
_LEVELS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often (and in whatever lambda) ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(a: Column) -> Column:
    """Inclusive running sums of a short array: appending copies, so the cost is its square."""
    zero = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("sum"))
    return F.aggregate(a, zero, lambda s, x: F.struct(F.concat(s["all"], F.array(s["sum"] + x)).alias("all"), (s["sum"] + x).alias("sum")), lambda s: s["all"])


def _sums(a: Column, levels: int) -> Column:
    if not levels:
        return _running(a)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / _BLOCK).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: _running(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))
        upto = let(totals, lambda t: _sums(t, levels - 1))
        return F.flatten(F.zip_with(parts, upto, lambda p, u: F.transform(p, lambda x: x + u - F.element_at(p, -1))))

    return let(blocks, whole)


def running_sums(a: Column) -> Column:
    """Inclusive running sums of an array of any length, in blocks of blocks."""
    return let(a, lambda x: _sums(x, _LEVELS))


def token_pieces(text: Column) -> Column:
    """Whitespace tokens, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))


def token_ends(pieces: Column) -> Column:
    """Where each token ends in the text: running lengths of the pieces."""
    return running_sums(F.transform(pieces, F.length))


@F.arrow_udf(_SPANS)
def _token_spans(texts: pa.Array) -> pa.Array:
    """By the batch: all its texts lie in one string, with a line break between each two; a part of the batch at a time."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes + 1) // _AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    made = []
    for a, b in zip(cuts, cuts[1:]):
        part = texts.slice(a, b - a)
        starts, ends = word_places("\n".join(pc.fill_null(part, "").to_pylist()), WHITE_SPACE)
        base = np.r_[0, np.cumsum(sizes[a:b] + 1)]
        first = np.searchsorted(starts, base)
        own = np.repeat(base[:-1], np.diff(first))
        spans = pa.StructArray.from_arrays([pa.array((x - own).astype(np.int32)) for x in (starts, ends)], ["s", "e"])
        made.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans, mask=part.is_null()))
    give_back()
    return pa.concat_arrays(made)


def token_spans(text: Column) -> Column:
    """array<struct<s,e>> of whitespace tokens."""
    return _token_spans(text)


def chunk_id(source_id: Column, level: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_id, level, start.cast("string"), end.cast("string"), F.sha2(text, 256)), 256)


def to_int(value: Column, default: int = 0) -> Column:
    """Integral strings (blanks around allowed) and truncated numbers; else the default."""
    return F.coalesce(F.try_cast(value, "int") if hasattr(F, "try_cast") else value.try_cast("int"), F.lit(default))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def nature_of(path: Column, root: str, marker: str) -> Column:
    """The path part after the marker folder, else the first part under the root, else empty."""
    after = F.regexp_extract(path, rf"(?:^|/){re.escape(marker)}/([^/]+)", 1)
    under = F.regexp_extract(path, rf"^{re.escape(root.rstrip('/'))}/([^/]+)", 1)
    return F.when(after != "", after).otherwise(under)


def citation_labels(answer: Column) -> Column:
    """Numbers of [C<digits>] labels, distinct, by first appearance (as strings)."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[C(\d+)\]"), F.lit(1)))


def rewrite_citations(answer: Column, valid: Column) -> Column:
    """All labels at once: valid ones become C1.. by place in ``valid``, others vanish; white space is tidied."""
    pieces = F.split(answer, r"\[C\d+\]", -1)
    labels = F.concat(F.regexp_extract_all(answer, F.lit(r"\[C(\d+)\]"), F.lit(1)), F.array(F.lit("")))
    place = lambda label: F.array_position(valid, label)
    new = lambda label: F.when(place(label) > 0, F.concat(F.lit("[C"), place(label).cast("string"), F.lit("]"))).otherwise("")
    return tidy(F.array_join(F.zip_with(pieces, labels, lambda p, label: F.concat(p, new(label))), ""))


def tidy(text: Column) -> Column:
    folded = strip(F.regexp_replace(text, r"(?U)\s{2,}", " "))
    return F.regexp_replace(folded, r"(?U)\s++([.,;:!?])", "$1")


# What unit types are called on display.
UNIT_NAMES = {"page": "Page", "paragraph": "Paragraphe", "slide": "Slide"}

#: Where labels that aren't C and a number sort.
LAST_LABEL = 10_000


def unit_name(unit_type: Column) -> Column:
    """The display name of a unit type in any case; others as they are, stripped."""
    raw = strip(F.coalesce(unit_type, F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(raw)), raw)


def label_order(label: Column) -> Column:
    """The number of a label such as C12, for sorting; what isn't one comes last."""
    number = F.regexp_extract(strip(F.coalesce(label, F.lit(""))), r"(?U)^C\s*([+-]?\d+)$", 1)
    return F.coalesce(number.try_cast("int"), F.lit(LAST_LABEL))
