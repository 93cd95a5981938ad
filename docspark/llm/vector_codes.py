"""Vectors as short codes: product quantisation in exact integers.

Components become integers floor(4096 x); a vector is cut into equal parts, and each part's
place has a codebook, refined by rounds of assigning and averaging. A round is one pass over
the vectors: workers assign batches of rows and give one sum for each codebook component, Spark
adds these up, and the driver, which holds the codebooks alone (their size is set by the vectors'
width, not by how many there are), divides exactly.

Assigning screens in single precision first: one matrix product gives the distances of all
rows of a batch to all entries, each with an interval that is proven to hold the exact
one (see ``screen``). Entries whose interval meets that of the best are evaluated again in
integers; of equal distances the lowest index stays. So the result is exact, as if all had been computed in integers.

Defined results: a vector that is null or holds a null or non-finite component goes, and so
does one with a component of 2 ** 50 or more (its squares fit no 64 bits) or of another
length than most have (of equally frequent lengths the greater counts); empty vectors are such a length. A length that the
number of parts doesn't divide is filled up with zeros, which adds nothing to a distance. Fewer vectors than entries make smaller
codebooks. Of repeated identifiers each row counts, the smaller vector first; a null identifier comes last. An error, or a sum of
errors, beyond 64 bits is null. An empty table gives no rows. Other columns are passed on by ``encode``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import arrow_map, free_name, join_counted, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of this size and more are left out.
LARGEST = 2.0**50
_UNIT32, _UNIT64 = 2.0**-24, 2.0**-53


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers by part, entry, position; ``width``: the vectors' length before filling up."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def array(self) -> np.ndarray:
        """(parts, entries, positions) in 64 bits."""
        return np.array(self.entries, np.int64)


def integers(vectors: pa.Array, parts: int, scale: int = SCALE) -> np.ndarray:
    """Lists of one length as (rows, parts, positions) of floor(scale x); a power of two scales without rounding."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    whole = np.floor(flat * scale).astype(np.int64)
    short = -whole.shape[1] % parts
    return np.pad(whole, ((0, 0), (0, short))).reshape(len(vectors), parts, -1)


def screen(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest: (parts, rows, entries) of booleans; the exact nearest ones are always among them.

    With |x|² left out, which all entries share, a distance is |c|² - 2 x·c. In single precision the product
    is off by at most g |x||c|, g = m u / (1 - m u), whatever the order of the sum; m is the length plus four, as both
    factors are rounded first. All else is double precision, whose own rounding is added with a margin.
    """
    length = x.shape[2]
    with np.errstate(over="ignore", invalid="ignore"):
        product = np.matmul(x.astype(np.float32).transpose(1, 0, 2), books.astype(np.float32).transpose(0, 2, 1)).astype(np.float64)
    m = (length + 4) * _UNIT32
    norm = lambda a: np.sqrt((a.astype(np.float64) ** 2).sum(-1)) * (1 + 1e-9)
    squares = (books.astype(np.float64) ** 2).sum(-1)[:, None, :]
    away = 2 * m / (1 - m) * norm(x).T[:, :, None] * norm(books)[:, None, :] + (length + 16) * 4 * _UNIT64 * (squares + 2 * np.abs(product))
    whole = np.isfinite(product) & (m < 0.5)
    middle, away = np.where(whole, squares - 2 * product, 0.0), np.where(whole, away * (1 + 1e-9), np.inf)
    return middle - away <= (middle + away).min(axis=2, keepdims=True)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis: in 64 bits where they fit, else in Python's integers."""
    if a.size and (float(np.abs(a).max()) + float(np.abs(b).max())) ** 2 * a.shape[-1] >= 2.0**62:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


def assign(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The index of each part's nearest entry, (rows, parts); ties go to the lowest."""
    may = screen(x, books)
    nearest = may.argmax(axis=2)
    open_ = may.sum(axis=2) > 1
    part, row, entry = np.nonzero(may & open_[:, :, None])
    if len(part):
        exact = _squares(x[row, part], books[part, entry])
        group = part * x.shape[0] + row  # sorted, as entries are in a group
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[first, len(group)])))
        hit = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]  # the first of a group's least
        nearest[part[hit], row[hit]] = entry[hit]
    return nearest.T


def _kept(vectors: DataFrame, vector_col: str) -> Column:
    return F.coalesce(F.forall(F.col(f"`{vector_col}`"), lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False))), F.lit(False))


def _of_width(vectors: DataFrame, vector_col: str, width: int) -> DataFrame:
    return vectors.where(_kept(vectors, vector_col) & (F.size(F.col(f"`{vector_col}`")) == width))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """The codebooks after ``rounds`` passes over all of ``vectors``, from the parts of the smallest identifiers on; None if no vector is kept."""
    ids, vector = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    sizes = vectors.where(_kept(vectors, vector_col)).groupBy(F.size(vector).alias("width")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return None
    width = most["width"]
    kept = _of_width(vectors, vector_col, width).select(ids.alias("id"), vector.alias("vector"))
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    books = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts, scale).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _averaged(kept.select("vector"), books, scale)
    return Codebooks(tuple(tuple(tuple(int(x) for x in e) for e in part) for part in books), width)


def _averaged(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: parts are assigned, and each entry becomes the floor of its parts' mean; unused entries stay."""
    parts, entries, length = books.shape
    schema = "part int, entry int, place int, n bigint, total decimal(28,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(0), parts, scale)
            code = assign(x, books)
            wide = x.astype(object) if len(x) and float(np.abs(x).max()) * len(x) >= 2.0**62 else x
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    of = code[:, p] == e
                    totals[p, e] += wide[of, p].sum(axis=0)
                    counts[p, e] += int(of.sum())
        p, e, i = (a.ravel() for a in np.indices(books.shape, np.int32))
        used = np.repeat(counts.ravel(), length) > 0
        pick = lambda a: a.ravel()[used]
        yield pa.RecordBatch.from_arrays([*(pa.array(pick(a), pa.int32()) for a in (p, e, i)), pa.array(np.repeat(counts.ravel(), length)[used]), pa.array([int(t) for t in pick(totals)], pa.decimal128(28, 0))], ["part", "entry", "place", "n", "total"])

    sums = arrow_map(kept, run, schema).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in sums.collect():  # one number for each codebook component
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", code: str = "code", error: str = "error", scale: int = SCALE) -> DataFrame:
    """``vectors`` that are kept, with ``code`` (two hex digits a part) and ``error`` (squared distances to the entries, summed)."""
    kept = _of_width(vectors, vector_col, books.width)
    code, error = free_name(kept, code), free_name(kept, error)
    at, table, names = kept.columns.index(vector_col), books.array(), [*kept.columns, code, error]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(at), len(table), scale)
            codes = assign(x, table)
            digits, step = codes.astype(np.uint8).tobytes().hex(), 2 * len(table)
            errors = _squares(x, table[np.arange(len(table)), codes])
            errors = errors.sum(axis=1) if errors.dtype != object and (not errors.size or float(errors.max()) < 2.0**59) else errors.astype(object).sum(axis=1)
            made = [pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())]))


def add_label_error(coded: DataFrame, label_col: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of equal label, nulls together."""
    coded = materialize(coded, "vector-codes")
    out, n, label, one = free_name(coded, out), free_name(coded, "__n"), F.col(f"`{label_col}`"), F.col(f"`{error}`")
    total = F.sum(one.cast("decimal(38,0)"))
    whole = F.when(F.count(F.lit(1)) == F.count(one), total).try_cast("bigint")
    sums = materialize(coded.groupBy(label).agg(F.count(F.lit(1)).alias(n), whole.alias(out)), "label-errors")
    rows = sums.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return join_counted(coded, sums, [label_col], n, rows).drop(n)
