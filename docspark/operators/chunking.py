"""From texts to units, token windows, chunks and their graph.

A document's chunks depend on that document alone, so all of it is one pass by Arrow batch over
the documents, with no shuffle, and a row that leaves it holds its own text only. Within a batch
nothing goes by document: places of all its texts are arrays, windows of all documents advance together,
and boundaries, units, parents and neighbours are found by searches in sorted arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docspark.config import Chunking, Window
from docspark.functions import text as X
from docspark.functions.arrow import bounded, released
from docspark.functions.spans import spanner, word_places

SEPARATOR = "\n\n"


def materialize_units(units: Column) -> Column:
    """Raw units (unit_type, unit_index, text) to (text, units with offsets): blank ones dropped, joined by a blank line."""
    clean = F.filter(F.transform(units, lambda u: F.struct(u["unit_type"].alias("unit_type"), u["unit_index"].cast("int").alias("unit_index"), X.normalize_line(u["text"]).alias("text"))), lambda u: F.length(u["text"]) > 0)

    def placed(c: Column) -> Column:
        ends = X.running_sums(F.transform(c, lambda u: F.length(u["text"]) + len(SEPARATOR)))
        at = F.zip_with(c, ends, lambda u, e: F.struct(u["unit_type"].alias("unit_type"), u["unit_index"].alias("unit_index"), u["text"].alias("text"), (e - len(SEPARATOR) - F.length(u["text"])).alias("start_char"), (e - len(SEPARATOR)).alias("end_char")))
        return F.struct(F.array_join(F.transform(c, lambda u: u["text"]), SEPARATOR).alias("text"), at.alias("units"))

    return X.let(clean, placed)


def document_stats(text: Column, units: Column) -> Column:
    """(unit_count, char_count)."""
    return F.struct(F.size(F.coalesce(units, F.array())).alias("unit_count"), F.length(text).alias("char_count"))


def sections(paragraphs: DataFrame, doc: str = "doc", pos: str = "pos", text: str = "text", heading: str = "is_heading") -> DataFrame:
    """Gaps and islands: a section begins at each heading; what comes before the first has no title. (doc, section, title, text)."""
    w = W.partitionBy(doc).orderBy(pos)
    numbered = paragraphs.withColumn("section", F.sum(F.col(heading).cast("int")).over(w))
    joined = numbered.groupBy(doc, "section").agg(F.array_sort(F.collect_list(F.struct(pos, heading, text))).alias("p"))
    title = F.when(F.col("p")[0][heading], F.col("p")[0][text])
    return joined.select(doc, F.dense_rank().over(W.partitionBy(doc).orderBy("section")).alias("section"), title.alias("title"), F.array_join(F.transform("p", lambda x: x[text]), "\n").alias("text"))


# ---- a batch of documents ----
#
# The texts of a batch lie one after another in one string, a line break between each two, so a place in it is one number
# and tells the document too. Tokens, units, windows and chunks of all documents are arrays of
# such places, in rising order, and what belongs together is found by searching one array in another.

#: Characters of texts that are worked on together (one text at least).
BATCH_CHARS = 1_000_000


@dataclass
class Batch:
    """Texts and their tokens and units as arrays of places."""

    sources: list[str]
    joined: str
    base: np.ndarray  # where each text begins, and one past the last
    starts: np.ndarray  # of tokens
    ends: np.ndarray
    first: np.ndarray  # the number of each text's first token, and how many tokens there are
    names: list[str]  # what cut each text
    unit_start: np.ndarray
    unit_end: np.ndarray
    unit_doc: np.ndarray
    unit_type: np.ndarray
    unit_index: np.ndarray

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1


def read_batch(sources: list[str], texts: list[str], units: pa.ListArray, spans) -> Batch:
    """Places of a batch. Units are clipped to their text, blank ones go; a text without units, or with ones that overlap, is one unit."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.r_[0, np.cumsum(sizes + 1)]
    joined = "\n".join(texts)
    word_start, word_end = word_places(joined)
    found = None if spans is None else [spans(t) for t in texts]
    if found is None:
        starts, ends, names = word_start, word_end, ["whitespace"] * len(texts)
    else:
        starts, ends = (np.concatenate([np.array(s[k], np.int64) + b for (s, _), b in zip(found, base)] or [np.zeros(0, np.int64)]) for k in (0, 1))
        names = [name for _, name in found]
    first = np.searchsorted(starts, base)
    # units
    doc = np.repeat(np.arange(len(texts)), np.diff(units.offsets.to_numpy()))
    flat = units.flatten()
    number = lambda name: flat.field(name).to_numpy(zero_copy_only=False).astype(float)
    there = ~np.isnan(number("start_char")) & ~np.isnan(number("end_char"))
    place = lambda name: np.clip(np.nan_to_num(number(name)).astype(np.int64), 0, sizes[doc]) + base[doc]
    left, right = place("start_char"), place("end_char")
    word = np.searchsorted(word_end, left, side="right")  # the first word that ends behind the unit's start
    there &= np.r_[word_start, base[-1]][word] < right
    order = np.flatnonzero(there)
    order = order[np.lexsort((right[order], left[order]))]
    doc, left, right = doc[order], left[order], right[order]
    crossed = doc[1:][(doc[1:] == doc[:-1]) & (left[1:] < right[:-1])]
    whole = np.setdiff1d(np.arange(len(texts)), np.setdiff1d(doc, crossed))  # texts that are one unit
    own = ~np.isin(doc, whole)
    kinds = np.array([x if x is not None else "unit" for x in flat.field("unit_type").to_pylist()], object)[order][own]
    index = np.nan_to_num(number("unit_index"), nan=1).astype(np.int64)[order][own]
    doc, left, right = np.r_[doc[own], whole], np.r_[left[own], base[whole]], np.r_[right[own], base[whole] + sizes[whole]]
    kinds, index = np.r_[kinds, np.full(len(whole), "document", object)], np.r_[index, np.ones(len(whole), np.int64)]
    order = np.lexsort((left, doc))
    return Batch(sources, joined, base, starts, ends, first, names, left[order], right[order], doc[order], kinds[order], index[order])


def boundaries(batch: Batch) -> np.ndarray:
    """Numbers of tokens before which a unit has ended, strictly inside their texts, rising."""
    at = np.searchsorted(batch.ends, batch.unit_end, side="right")
    return np.unique(at[(at > batch.first[batch.unit_doc]) & (at < batch.first[batch.unit_doc + 1])])


def windows(first: np.ndarray, bounds: np.ndarray, w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all windows, in order; ``first``: where each document's tokens begin, and their number.

    All documents advance together, a window each a step. A window ends at the unit boundary that is nearest to its target (the
    lower of two) within its limits, else at its target; the next begins ``overlap`` before. A remainder up to the
    longest window is the last one, or widens the one before if it is below the shortest.
    """
    edges = np.r_[bounds, np.iinfo(np.int64).max]
    doc = np.flatnonzero(np.diff(first) > 0)
    start, made = first[doc], []
    widened = np.zeros(len(first) - 1, bool)
    stepped = np.zeros(len(doc), bool)
    while len(doc):
        stop = first[doc + 1]
        last = stop - start <= w.max_tokens
        short = last & stepped & (stop - start < w.min_tokens)
        widened[doc[short]] = True
        ideal = start + w.target_tokens
        after = np.searchsorted(bounds, ideal)
        above, below = edges[after], np.where(after > 0, edges[np.maximum(after, 1) - 1], -1)
        above_in, below_in = above <= start + w.max_tokens, below >= start + w.min_tokens
        near = np.where(below_in & (~above_in | (ideal - below <= above - ideal)), below, np.where(above_in, above, ideal))
        end = np.where(last, stop, near)
        made.append((doc[~short], start[~short], end[~short]))
        more = ~last
        doc, start = doc[more], np.where(end - w.overlap_tokens > start, end - w.overlap_tokens, end)[more]
        stepped = np.ones(len(doc), bool)
    doc, start, end = (np.concatenate([m[i] for m in made] or [np.zeros(0, np.int64)]) for i in range(3))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    final = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
    return doc, start, np.where(final & widened[doc], first[doc + 1], end)


@dataclass
class Chunks:
    """One level's chunks of a batch, by document and place."""

    level: str
    doc: np.ndarray
    tokens: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    ids: np.ndarray

    def take(self, which: np.ndarray) -> Chunks:
        return Chunks(self.level, *(a[which] for a in (self.doc, self.tokens, self.start, self.end, self.text, self.ids)))


def cut(batch: Batch, bounds: np.ndarray, w: Window) -> Chunks:
    """Windows as chunks, without the white space around their texts; those of white space alone are none."""
    doc, s, e = windows(batch.first, bounds, w)
    left, right = batch.starts[s], batch.ends[e - 1]
    raw = [batch.joined[a:b] for a, b in zip(left.tolist(), right.tolist())]
    body = [x.strip() for x in raw]
    size = np.array([len(x) for x in body], np.int64)
    start = left + np.array([len(x) - len(x.lstrip()) for x in raw], np.int64)
    own = start - batch.base[doc]
    ids = [chunk_id(batch.sources[d], w.level, a, a + n, t) for d, a, n, t in zip(doc.tolist(), own.tolist(), size.tolist(), body)]
    texts = lambda x: np.array([*x, None], object)[:-1]  # noqa: E731 (an array of objects whatever they are)
    found = Chunks(w.level, doc, e - s, start, start + size, texts(body), texts(ids))
    return found.take(np.flatnonzero(size > 0))


def chunk_id(source: str, level: str, start: int, end: int, text: str) -> str:
    return hashlib.sha256(f"{source}:{level}:{start}:{end}:{hashlib.sha256(text.encode()).hexdigest()}".encode()).hexdigest()


def long_enough(chunks: Chunks, least: int) -> Chunks:
    """Chunks of ``least`` tokens and more; of a document that has none its longest, the first of equals."""
    kept = chunks.tokens >= least
    order = np.lexsort((chunks.start, -chunks.tokens, chunks.doc))
    longest = order[np.r_[True, chunks.doc[order][1:] != chunks.doc[order][:-1]][: len(order)]]
    return chunks.take(np.flatnonzero(kept | (np.isin(np.arange(len(kept)), longest) & ~np.isin(chunks.doc, chunks.doc[kept]))))


def parents_of(leaves: Chunks, parents: Chunks) -> np.ndarray:
    """The parent's identifier of each leaf: of the first parent that ends behind the leaf's start, the next and the one before, the one that shares most with it; the first of equals."""
    none = len(parents.doc)
    low, high = np.searchsorted(parents.doc, leaves.doc), np.searchsorted(parents.doc, leaves.doc, side="right")
    at = np.clip(np.searchsorted(parents.end, leaves.start, side="right"), low, np.maximum(high - 1, low))
    tried = np.stack([at, at + 1, at - 1])
    valid = (tried >= low) & (tried < high)
    tried = np.where(valid, tried, none)
    start, end = np.r_[parents.start, 0], np.r_[parents.end, 0]
    shared = np.where(valid, np.maximum(np.minimum(end[tried], leaves.end) - np.maximum(start[tried], leaves.start), 0), -1)
    best = tried[shared.argmax(axis=0), np.arange(len(leaves.doc))]
    return np.append(parents.ids, "")[best]


# A chunk's fields.
CHUNK = (
    "chunk_id string, source_id string, level string, text string, token_count int, start_char int, end_char int, unit_type_start string, unit_index_start int, unit_type_end string, unit_index_end int, "
    "prev_id string, next_id string, parent_id string, tokenizer string"
)
_UNITS = "array<struct<unit_type:string,unit_index:int,start_char:int,end_char:int>>"


def _rows(batch: Batch, chunks: Chunks, parents: np.ndarray) -> pa.RecordBatch:
    """Chunks as CHUNK: with their places in their own texts, the units of both ends and their neighbours."""
    doc = chunks.doc
    low, high = np.searchsorted(batch.unit_doc, doc), np.searchsorted(batch.unit_doc, doc, side="right") - 1
    one = np.minimum(np.searchsorted(batch.unit_end, chunks.start, side="right"), high)  # the first unit that ends behind the start
    two = np.maximum(np.searchsorted(batch.unit_start, chunks.end) - 1, low)  # the last one that begins before the end
    same = doc[1:] == doc[:-1]
    before, after = np.full(len(doc), "", object), np.full(len(doc), "", object)
    before[1:][same], after[:-1][same] = chunks.ids[:-1][same], chunks.ids[1:][same]
    of = lambda names: np.array([*names, None], object)[:-1][doc]
    own = batch.base[doc]
    columns = [chunks.ids, of(batch.sources), np.full(len(doc), chunks.level, object), chunks.text, chunks.tokens, chunks.start - own, chunks.end - own, batch.unit_type[one], batch.unit_index[one], batch.unit_type[two], batch.unit_index[two], before, after, parents, of(batch.names)]
    names, kinds = zip(*map(str.split, CHUNK.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int32()) for c, k in zip(columns, kinds)], list(names))


# ---- all documents ----


def _by_batch(docs: DataFrame, config: Chunking, each, schema: str) -> DataFrame:
    """Rows that ``each`` makes of batches of (source_id, text, units); null texts are empty."""
    units = F.transform("units", lambda u: F.struct(u["unit_type"].alias("unit_type"), u["unit_index"].alias("unit_index"), u["start_char"].alias("start_char"), u["end_char"].alias("end_char")))
    rows = docs.select(F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(units.cast(_UNITS), F.array().cast(_UNITS)).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = None if config.tokenizer == "whitespace" else spanner(config.tokenizer, config.vocabulary)
        for rows in batches:
            upto = np.cumsum(pc.utf8_length(rows.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // BATCH_CHARS
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist()], [*cuts[1:], rows.num_rows]):
                part = rows.slice(a, b - a)
                yield from each(read_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), spans)) if b > a else ()

    return bounded(rows).mapInArrow(released(run), schema)


def chunk(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """``docs`` (source_id, text, units) to all chunks of both levels, as CHUNK."""

    def each(batch: Batch) -> Iterator[pa.RecordBatch]:
        bounds = boundaries(batch)
        parents, leaves = cut(batch, bounds, config.parent), long_enough(cut(batch, bounds, config.leaf), config.min_leaf_tokens)
        yield _rows(batch, leaves, parents_of(leaves, parents))
        yield _rows(batch, parents, np.full(len(parents.doc), "", object))

    return _by_batch(docs, config, each, CHUNK)


def build_chunks(docs: DataFrame, config: Chunking = Chunking()) -> tuple[DataFrame, DataFrame]:
    """Leaf and parent chunks."""
    chunks = chunk(docs, config)
    return chunks.where("level = 'leaf'"), chunks.where("level = 'parent'")


def _of_sources(batch: Batch, doc: np.ndarray) -> pa.Array:
    return pa.array(batch.sources, pa.string()).take(pa.array(doc))


def token_windows(docs: DataFrame, w: Window, config: Chunking = Chunking()) -> DataFrame:
    """(source_id, k, s, e): each document's windows, as token positions."""

    def each(batch: Batch) -> Iterator[pa.RecordBatch]:
        doc, s, e = windows(batch.first, boundaries(batch), w)
        k = np.arange(len(doc)) - np.searchsorted(doc, doc)
        yield pa.RecordBatch.from_arrays([_of_sources(batch, doc), *(pa.array(a, pa.int32()) for a in (k, s - batch.first[doc], e - batch.first[doc]))], ["source_id", "k", "s", "e"])

    return _by_batch(docs, config, each, "source_id string, k int, s int, e int")


def unit_boundaries(docs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(source_id, n_tokens, boundary): the token positions at which a document's units end."""

    def each(batch: Batch) -> Iterator[pa.RecordBatch]:
        at = boundaries(batch)
        doc = np.searchsorted(batch.first, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([_of_sources(batch, doc), *(pa.array(a, pa.int32()) for a in (np.diff(batch.first)[doc], at - batch.first[doc]))], ["source_id", "n_tokens", "boundary"])

    return _by_batch(docs, config, each, "source_id string, n_tokens int, boundary int")
