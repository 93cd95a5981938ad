"""Removal of byte strings of LENGTH and more that repeat anywhere in the corpus.

Equal strings share content-defined anchors (anchors.py), so suffixes need
comparing only where they pass an anchor of equal hash. In steps:

1. Texts are packed (Zstandard) and numbered in the shared folder.
2. Each text's anchors give the hash of the anchor and of its context, the bytes of
   all strings of LENGTH that hold the anchor. Contexts that repeat inside an Arrow
   batch are settled at once, so a group of copies sends a row per batch, not per copy.
3. Dealt by anchor: a context seen twice makes all its strings repeats. Of an
   anchor with several contexts, one occurrence of each goes on.
4. Their contexts are dealt by anchor and sorted into an index family: each batch gets
   its sorted array of suffixes cut at LENGTH bytes (ordered by anchor, offset and a
   fingerprint of the bytes; equal neighbours are confirmed byte by byte), is
   merge-scanned against the levels of the same anchor, and levels of like size
   merge, so that sizes grow geometrically. An anchor of over HOT_CONTEXTS contexts is
   not one task's: the range of its strings is halved, and each context is dealt once for
   each half, by the bytes that all strings of the half hold. Equal pieces are settled
   on the way, and groups still too large are halved again, down to single strings.
5. Spans go back to their texts, and what they cover is removed.

The order inside the arrays is by fingerprint, not by alphabet: only equality of
LENGTH bytes is asked for, and it sorts as eight bytes instead of 200.

Defined results: a null text counts as empty; matches never cross documents; rows
that repeat an identifier or a text are rows of their own and so repeats of each
other; texts shorter than LENGTH keep all; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.anchors import GRAM, LENGTH, anchors
from docspark.llm.common import arrow_map, materialize

#: Bytes of a context before its anchor, and all in all.
BEFORE = LENGTH - GRAM
WIDTH = BEFORE + LENGTH
#: Strings of LENGTH in a full context.
STRINGS = BEFORE + 1
#: Contexts that one sorted array begins with.
FAMILY_BATCH = 2048
#: Contexts of one anchor that one family takes; larger groups are halved.
HOT_CONTEXTS = 8192

MARKS = "uid bigint, start int, end int, h bigint, pos int"
#: (lo, hi): the range of strings that a context stands for.
CONTEXTS = "h bigint, uid bigint, pos int, before int, context binary, lo int, hi int, hot boolean"
#: Rows without a context are spans that are settled; those without a range go to their anchor's family.
PIECES = "h bigint, c bigint, uid bigint, pos int, before int, context binary, lo int, hi int, start int, end int"


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, n_bytes, z): texts compressed, rows numbered; written once."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [b"" if not t.is_valid else t.as_buffer().to_pybytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["uid", "doc_id", "n_bytes", "z"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(arrow_map(rows, run, "uid bigint, doc_id bigint, n_bytes bigint, z binary"), "packed")


def _unpacked(column, lengths) -> Iterator[bytes]:
    loosen = zstandard.ZstdDecompressor()
    for z, n in zip(column, lengths):
        yield loosen.decompress(z.as_buffer(), max_output_size=max(1, n.as_py()))


def _probe(batches) -> Iterator[pa.RecordBatch]:
    """Step 2: of each context in the batch one row (h, c, uid, pos, n), and the spans of those that repeat in it."""
    for batch in batches:
        uids = batch.column(0).to_numpy()
        texts = list(_unpacked(batch.column(2), batch.column(1)))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = b"".join(texts)
        del texts
        found = list(anchors(np.frombuffer(data, np.uint8), offsets))
        if not found:
            continue
        at, which = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
        h = np.concatenate([x for _, x in found])[which]
        doc = np.searchsorted(offsets, at, "right") - 1
        start, end = np.maximum(at - BEFORE, offsets[doc]), np.minimum(at + LENGTH, offsets[doc + 1])
        view, hashed = memoryview(data), xxhash.xxh3_64_intdigest
        c = np.fromiter((hashed(view[s:e], int(b)) for s, e, b in zip(start.tolist(), end.tolist(), (at - start).tolist())), np.uint64, len(at))
        order = np.lexsort((c, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
        run = np.cumsum(new) - 1
        n = np.bincount(run)
        first = order[new]
        rows = [h[first].view(np.int64), c[first].view(np.int64), uids[doc[first]], (at - offsets[doc])[first].astype(np.int32), n.astype(np.int32), np.zeros(len(first), np.int32)]
        settled = order[n[run] > 1]
        d, s, e = _union(doc[settled], start[settled], end[settled])
        # settled spans go along, dealt anywhere: pos is their start, last their end
        none = np.zeros(len(d), np.int64)
        rows = [np.concatenate(x) for x in zip(rows, [uids[d] * 2 + 1, none, uids[d], (s - offsets[d]).astype(np.int32), none.astype(np.int32), (e - offsets[d]).astype(np.int32)])]
        for i in range(0, len(rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in rows], ["h", "c", "uid", "pos", "n", "last"])


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, joined where they meet."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(end)  # positions rise from document to document
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def _whole_groups(batches, keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that end where the first of ``keys`` changes, from batches sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not len(t):
            continue
        h = t.column(keys[0]).to_numpy()
        before = np.flatnonzero(h != h[-1])
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _settle(batches) -> Iterator[pa.RecordBatch]:
    """Step 3: rows sorted by (h, c) to spans that are repeats (start, end) and occurrences to compare (h, pos)."""
    for t in _whole_groups(batches, ("h",)):
        h, c, uid, pos, n, last = (t.column(x).to_numpy() for x in ("h", "c", "uid", "pos", "n", "last"))
        probe = n > 0
        known = ~probe
        h, c, uids, at, n = h[probe], c[probe], uid[probe], pos[probe], n[probe]
        out = [(uid[known], pos[known], last[known])]
        if len(h):
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            run_c, run_h = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
            seen = np.bincount(run_c, n)
            contexts = np.bincount(run_h, new_c)
            full = seen[run_c] > 1
            out.append((uids[full], np.maximum(at[full] - BEFORE, 0), at[full] + LENGTH))
            need = new_c & (contexts[run_h] > 1)
        else:
            need = np.zeros(0, bool)
        u, s, e = (np.concatenate([x[i] for x in out]) for i in range(3))
        k, m = int(need.sum()), len(u)
        whole = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(k, kind)])
        part = lambda x, kind: pa.concat_arrays([pa.nulls(m, kind), pa.array(x, kind)])
        if m + k:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([u, uids[need]]), pa.int64()), whole(s.astype(np.int32), pa.int32()), whole(e.astype(np.int32), pa.int32()), part(h[need], pa.int64()), part(at[need].astype(np.int32), pa.int32())],
                ["uid", "start", "end", "h", "pos"],
            )


def _contexts(batches) -> Iterator[pa.RecordBatch]:
    """Step 4, first half: the bytes around each occurrence to compare."""
    for batch in batches:
        h, uid, pos, before, bytes_, hot = [], [], [], [], [], []
        for u, text, marks in zip(batch.column(0).to_pylist(), _unpacked(batch.column(2), batch.column(1)), batch.column(3).to_pylist()):
            for mark in marks:
                p = mark["pos"]
                s = max(0, p - BEFORE)
                h.append(mark["h"])
                uid.append(u)
                pos.append(p)
                before.append(p - s)
                bytes_.append(text[s : p + LENGTH])
                hot.append(mark["hot"])
            if len(h) > 20_000:
                yield _context_batch(h, uid, pos, before, bytes_, hot)
                h, uid, pos, before, bytes_, hot = [], [], [], [], [], []
        if h:
            yield _context_batch(h, uid, pos, before, bytes_, hot)


def _context_batch(h, uid, pos, before, bytes_, hot) -> pa.RecordBatch:
    whole = np.zeros(len(h), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(uid, pa.int64()), pa.array(pos, pa.int32()), pa.array(before, pa.int32()), pa.array(bytes_, pa.binary()), pa.array(whole), pa.array(whole + BEFORE), pa.array(hot, pa.bool_())], _names(CONTEXTS))


_BASE = np.uint64(0x100000001B3)
with np.errstate(over="ignore"):
    _POWER = np.uint64(pow(0x100000001B3, LENGTH, 1 << 64))


class SuffixFamily:
    """Sorted arrays of suffixes cut at LENGTH bytes, in levels of geometric sizes.

    ``add`` takes a batch of contexts of one or many anchors; ``dup[i, s]`` tells
    afterwards whether the string that begins at byte ``s`` of context ``i`` also
    begins in another context of its anchor.
    """

    def __init__(self):
        self.bytes = np.zeros((0, WIDTH), np.uint8)
        self.h = np.zeros(0, np.int64)
        self.dup = np.zeros((0, STRINGS), bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys in order, places: context * STRINGS + start

    def add(self, h: np.ndarray, before: list[int], contexts: list[bytes]) -> None:
        old, m = len(self.h), len(h)
        data = np.zeros((m, WIDTH), np.uint8)
        valid = np.zeros((m, STRINGS), bool)
        for i, (b, text) in enumerate(zip(before, contexts)):
            data[i, BEFORE - b : BEFORE - b + len(text)] = np.frombuffer(text, np.uint8)
            valid[i, BEFORE - b : max(BEFORE - b, BEFORE - b + len(text) - LENGTH + 1)] = True
        self.bytes, self.h = np.concatenate([self.bytes, data]), np.concatenate([self.h, h])
        self.dup = np.concatenate([self.dup, np.zeros((m, STRINGS), bool)])
        sums = np.zeros((WIDTH + 1, m), np.uint64)
        for i in range(WIDTH):
            sums[i + 1] = sums[i] * _BASE + data[:, i] + np.uint64(1)
        keys = (sums[LENGTH:] - sums[:STRINGS] * _POWER).T
        keys = keys ^ (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        keys = (keys + np.arange(STRINGS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[valid]
        places = (np.flatnonzero(valid.ravel()) + old * STRINGS).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        level = (keys[order], places[order])
        self._scan(*level)
        for other in self.levels:
            self._merge_scan(level, other)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (ka, pa_), (kb, pb) = self.levels.pop(), self.levels.pop()
            keys, places = np.concatenate([kb, ka]), np.concatenate([pb, pa_])
            order = np.argsort(keys, kind="stable")  # two runs: a merge
            self.levels.append((keys[order], places[order]))

    def _scan(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Repeats inside one array: equal keys are neighbours."""
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self._confirm(places[same], places[same + 1])

    def _merge_scan(self, level, other) -> None:
        (keys, places), (have, there) = level, other
        at = np.searchsorted(have, keys)
        end = np.searchsorted(have, keys, "right")
        hit = np.flatnonzero(end > at)
        self._confirm(places[hit], there[at[hit]])
        many = hit[end[hit] - at[hit] > 1]  # equal keys of a level were confirmed among themselves before
        self._confirm(places[many], there[end[many] - 1])

    def _confirm(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 50_000):
            x, y = a[i : i + 50_000], b[i : i + 50_000]
            cx, sx, cy, sy = x // STRINGS, x % STRINGS, y // STRINGS, y % STRINGS
            ok = (self.h[cx] == self.h[cy]) & (sx == sy)
            strings = np.lib.stride_tricks.sliding_window_view(self.bytes, LENGTH, axis=1)
            ok[ok] = (strings[cx[ok], sx[ok]] == strings[cy[ok], sy[ok]]).all(axis=1)
            self.dup[cx[ok], sx[ok]] = True
            self.dup[cy[ok], sy[ok]] = True


def _compare(batches) -> Iterator[pa.RecordBatch]:
    """Step 4, second half: spans of what repeats, from contexts sorted by anchor."""
    family, uid, pos = SuffixFamily(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spans(upto: int):
        """Of the first contexts of the family."""
        edge = np.diff(np.pad(family.dup[:upto].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, s = np.nonzero(edge == 1)
        e = np.nonzero(edge == -1)[1]
        return pa.RecordBatch.from_arrays([pa.array(uid[i], pa.int64()), pa.array((pos[i] - BEFORE + s).astype(np.int32)), pa.array((pos[i] - BEFORE + e - 1 + LENGTH).astype(np.int32))], ["uid", "start", "end"])

    for batch in batches:
        for at in range(0, batch.num_rows, FAMILY_BATCH):
            part = batch.slice(at, FAMILY_BATCH)
            h = part.column(0).to_numpy()
            if len(family.h) and family.h[-1] != h[0]:
                yield spans(len(family.h))
                family, uid, pos = SuffixFamily(), uid[:0], pos[:0]
            # anchors that end in this part need no family
            open_ = int(np.flatnonzero(h == h[-1])[0])
            for a, b in ((0, open_), (open_, len(h))):
                if a == b:
                    continue
                family.add(h[a:b], part.column(3).to_pylist()[a:b], part.column(4).to_pylist()[a:b])
                uid, pos = np.concatenate([uid, part.column(1).to_numpy()[a:b]]), np.concatenate([pos, part.column(2).to_numpy()[a:b].astype(np.int64)])
                if b == open_:
                    yield spans(len(family.h))
                    family, uid, pos = SuffixFamily(), uid[:0], pos[:0]
    if len(family.h):
        yield spans(len(family.h))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _pieces(found: pa.Table, settled: pa.Table) -> Iterator[pa.RecordBatch]:
    """``found`` as they are, and the spans of ``settled``, dealt anywhere."""
    k, uid = settled.num_rows, settled.column("uid")
    none = [pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())]
    spans = pa.table([uid, pa.array(np.zeros(k, np.int64)), uid, *none, settled.column("start"), settled.column("end")], _names(PIECES))
    yield from pa.concat_tables([found, spans]).combine_chunks().to_batches(20_000)


def _halve(batches) -> Iterator[pa.RecordBatch]:
    """From contexts of groups too large, with their range of strings (lo, hi), to the pieces for each half.

    A piece holds all the half's strings; ``h`` sums up the bytes that every one of
    them holds, so equal strings meet, and ``c`` the whole piece. Of pieces that are equal in
    the batch one goes on.
    """
    for batch in batches:
        rows: list[tuple] = []
        for h, uid, pos, before, context, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(7))):
            base, view = BEFORE - before, memoryview(context)
            mid = (lo + hi) // 2
            for a, z in ((lo, mid), (mid + 1, hi)):
                first, last = max(a, base), min(z, base + len(context) - LENGTH)
                if first > last:
                    continue  # of this half the context has no string
                piece = context[first - base : last + LENGTH - base]
                key = xxhash.xxh3_64_intdigest(view[z - base : a + LENGTH - base], (h + a * STRINGS + z) % (1 << 64))
                rows.append((key, xxhash.xxh3_64_intdigest(piece, first), uid, pos, BEFORE - first, piece, a, z, pos - BEFORE + first, pos - BEFORE + last + LENGTH))
        if not rows:
            continue
        h, c = (np.fromiter((r[i] for r in rows), np.uint64, len(rows)).view(np.int64) for i in (0, 1))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        found = pa.table([pa.array(h), pa.array(c), *(pa.array([r[i + 2] for r in rows], t) for i, t in enumerate(kinds))], _names(PIECES))
        order = np.lexsort((h, c))
        new, several = _runs(c[order], h[order])
        yield from _pieces(found.take(pa.array(order[new])), found.take(pa.array(order[several])))


def _runs(c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (c, h): which begin a run of equals, and which are of a run of several."""
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])
    run = np.cumsum(new) - 1
    return new, np.bincount(run)[run] > 1


def _settle_pieces(batches) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by (c, h) to one of each, and the spans of those that are several."""
    for t in _whole_groups(batches, ("c",)):
        spans = t.column("context").is_null().to_numpy()
        done, t = t.filter(pa.array(spans)), t.filter(pa.array(~spans))
        if t.num_rows:
            new, several = _runs(t.column("c").to_numpy(), t.column("h").to_numpy())
            settled = t.filter(pa.array(several))
            yield from _pieces(t.filter(pa.array(new)), pa.concat_tables([done, settled]))
        else:
            yield from done.combine_chunks().to_batches()


def _route(batches) -> Iterator[pa.RecordBatch]:
    """Contexts of anchors small enough as they are, those of others in halves."""
    for batch in batches:
        hot = batch.column(7)
        rows = pa.Table.from_batches([batch.filter(pc.invert(hot))])
        if k := rows.num_rows:
            none = pa.nulls(k, pa.int32())
            yield from pa.table([rows.column("h"), pa.array(np.zeros(k, np.int64)), *(rows.column(x) for x in ("uid", "pos", "before", "context")), none, none, none, none], _names(PIECES)).combine_chunks().to_batches()
        if hot.true_count:
            yield from _halve([batch.filter(hot)])


def _for_family(batch: pa.RecordBatch) -> int:
    """Rows with a context and without a range."""
    return pc.and_(pc.is_valid(batch.column(5)), pc.is_null(batch.column(6))).true_count


def _compare_and_settle(batches) -> Iterator[pa.RecordBatch]:
    """From rows sorted so that those for families come first, by anchor, and pieces after them, by (c, h)."""
    batches, rest = iter(batches), []

    def contexts():
        for batch in batches:
            n = _for_family(batch)
            if n:
                yield batch.slice(0, n).select(["h", "uid", "pos", "before", "context"])
            if n < batch.num_rows:
                rest.append(batch.slice(n))
                return

    for spans in _compare(contexts()):
        if spans.num_rows:
            t = pa.Table.from_batches([spans])
            none = pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())], _names(PIECES))
            yield from _pieces(none, t)
    yield from _settle_pieces(chain(rest, batches))


def _flagged(rows: DataFrame, hot_contexts: int) -> tuple[DataFrame, bool]:
    """``rows`` with ``hot``, whether their anchor has over ``hot_contexts`` of them, and whether there are such anchors."""
    hot = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_contexts).select("h", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot-anchors")  # at most one for so many rows
    if hot.isEmpty():
        return rows.withColumn("hot", F.lit(False)), False
    return rows.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), True


def repeated_spans(packed: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(uid, start, end): bytes covered by strings of LENGTH that also begin elsewhere; spans may overlap."""
    texts = packed.select("uid", "n_bytes", "z")
    probes = arrow_map(texts, _probe, "h bigint, c bigint, uid bigint, pos int, n int, last int")
    marks = materialize(arrow_map(probes.repartition("h").sortWithinPartitions("h", "c"), _settle, MARKS), "marks")

    spans = marks.where("start IS NOT NULL").select("uid", "start", "end")
    partial, hot = _flagged(marks.where("h IS NOT NULL").select("uid", "h", "pos"), hot_contexts)
    wanted = partial.groupBy("uid").agg(F.collect_list(F.struct("h", "pos", "hot")).alias("marks"))  # at most a text's anchors
    rows = arrow_map(texts.join(wanted, "uid").select("uid", "n_bytes", "z", "marks"), lambda batches: _route(_contexts(batches)), PIECES)
    while True:  # eight times at most, as ranges are halved from STRINGS to one
        family = F.col("context").isNotNull() & F.col("lo").isNull()
        dealt = rows.repartition("c", "h").sortWithinPartitions(~family, "c", "h")
        done = materialize(arrow_map(dealt, _compare_and_settle, PIECES), "compared")
        spans = spans.unionByName(done.where("context IS NULL").select("uid", "start", "end"))
        if not hot:
            return spans
        left = done.where("context IS NOT NULL AND lo < hi").select(*[n for n in _names(CONTEXTS) if n != "hot"])  # single strings are settled
        left, hot = _flagged(left, hot_contexts)
        rows = arrow_map(left.select(*_names(CONTEXTS)), _route, PIECES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, spans (flat start/end pairs of bytes), kept (the remaining bytes)."""
    packed = pack(docs, id_col, text_col)
    spans = repeated_spans(packed, hot_contexts).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            removed, flat, kept = [], [], []
            for text, spans in zip(_unpacked(batch.column(2), batch.column(1)), batch.column(3).to_pylist()):
                own, end, parts = [], 0, []
                for s, e in sorted((x["start"], min(x["end"], len(text))) for x in spans or ()):
                    if own and own[-1] >= s:
                        own[-1] = max(own[-1], e)
                    else:
                        own += [s, e]
                for i in range(0, len(own), 2):
                    parts.append(text[end : own[i]])
                    end = own[i + 1]
                kept.append(b"".join([*parts, text[end:]]))
                flat.append(own)
                removed.append(len(text) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return arrow_map(packed.join(spans, "uid", "left").select("doc_id", "n_bytes", "z", "spans"), run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<int>, kept binary")
