"""Near-duplicates by SimHash, linked by tiled exact comparison.

A fingerprint sums up the XXH64 hashes of a text's word shingles. Equal
fingerprints are one node (their copies are never paired). Nodes within the radius
are found exactly: the 64 bits are cut into radius + 2 blocks, and two
fingerprints at most ``radius`` bits apart agree on at least two of these, so
each node goes to one bucket for each pair of blocks. Nodes are sorted by bucket and
population count, the row of all of them is cut into tiles, and tiles are compared
with exclusive-or and bit counts: each with itself, and with those behind it that hold
the same bucket, until their population counts differ by more than the radius.
All buckets go this way, small ones many to a tile. A bucket gives a spanning
forest of its links, not the pairs, and the forests of all buckets make the components.

Buckets hold distinct fingerprints only: a group of copies, however large, is one
row. A bucket of more than BLOCK nodes is dealt by a hash of the node into blocks, and each
pair of blocks is a task's bucket of its own (a node goes to as many as there are
blocks), so memory and time of a task are bounded: a few bytes for each node of two blocks plus one tile of pairs.

Defined results: a null text counts as empty; a text without words has fingerprint
zero and links like any other; shorter texts than a shingle are one shingle; rows
with a null identifier get the class of their fingerprint, but don't link
by themselves; rows that repeat an identifier are the same document in the
components; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, materialize
from docspark.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 256
#: Nodes of a bucket that one task compares with each other; larger ones go in pairs of blocks.
BLOCK = 1 << 16


def _lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z, and white space is [\x20\x09-\x0D]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle in order; all words join a shingle if they are fewer."""
    words = _lowered_words(text.encode()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    view, hashed = memoryview(data), xxhash.xxh64_intdigest
    return np.fromiter((hashed(view[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit k is set if over half of ``hashes`` have it; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bits of a long text in pieces
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the shingles' hashes, repeats included; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed bigint)."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), run, "doc_id bigint, fp bigint")


def block_pairs(radius: int) -> list[int]:
    """Masks, one for each pair of the radius + 2 blocks of 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


class Trees:
    """Which tree each of ``n`` places is of; the smaller tree takes the number of the larger one."""

    def __init__(self, n: int):
        self.of, self.members = np.arange(n), {}

    def join(self, a: int, b: int) -> None:
        x, y = int(self.of[a]), int(self.of[b])
        own, other = self.members.pop(x, [x]), self.members.pop(y, [y])
        if len(own) < len(other):
            x, own, other = y, other, own
        self.of[other] = x
        own.extend(other)
        self.members[x] = own


def near_rows(fps: np.ndarray, radius: int, bucket: np.ndarray | None = None, side: np.ndarray | None = None, more: np.ndarray | None = None, more_radius: int = 0, trees: Trees | None = None):
    """Places of ``fps`` with those within ``radius`` of them in the same bucket: (place, other places), each pair once.

    In the bucket of a pair of blocks ``side`` is the block, and only places of different sides are compared; elsewhere it is -1.

    Tiles of TILE in order of bucket and population count are compared with exclusive-or and
    bit counts; tile pairs of other buckets, or whose population counts differ beyond the radius, are skipped.
    Memory is one tile of bits. ``more`` has further words of each fingerprint, a row each: of what is within the radius those
    pairs count that differ in ``more_radius`` bits of these at most. Tile pairs that are of one tree of ``trees`` are skipped.
    """
    ones = np.bitwise_count(fps).astype(np.int64)
    bucket = np.zeros(len(fps), np.int64) if bucket is None else bucket
    side = np.full(len(fps), -1) if side is None else side
    order = np.lexsort((ones, bucket))
    fps, ones, bucket, side = fps[order], ones[order], bucket[order], side[order]
    more = None if more is None else more[order]
    for i in range(0, len(fps), TILE):
        rows, of = fps[i : i + TILE], bucket[i : i + TILE]
        last, own = i + len(rows) - 1, side[i : i + TILE]
        for j in range(i, len(fps), TILE):
            if j > i and (bucket[j] != bucket[last] or ones[j] - ones[last] > radius):
                break  # later tiles lie further off still
            if trees is not None and (tree := trees.of[order[i]]) == trees.of[order[j]] and (trees.of[order[i : i + TILE]] == tree).all() and (trees.of[order[j : j + TILE]] == tree).all():
                continue
            near = (np.bitwise_count(rows[:, None] ^ fps[None, j : j + TILE]) <= radius) & (of[:, None] == bucket[None, j : j + TILE])
            if i == j:
                near = np.triu(near, 1)
            if (own >= 0).any():
                near &= (own[:, None] != side[None, j : j + TILE]) | (own < 0)[:, None]
            if more is not None:
                a, b = np.nonzero(near)
                near[a, b] = np.bitwise_count(more[i + a] ^ more[j + b]).sum(axis=1, dtype=np.int64) <= more_radius
            for a in np.flatnonzero(near.any(axis=1)).tolist():
                yield int(order[i + a]), order[np.flatnonzero(near[a]) + j]


def tile_links(fps: np.ndarray, radius: int, bucket: np.ndarray | None = None, side: np.ndarray | None = None, more: np.ndarray | None = None, more_radius: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``fps``. A row looks only at those of its neighbours that are not yet of its tree."""
    trees, links = Trees(len(fps)), []
    for a, others in near_rows(fps, radius, bucket, side, more, more_radius, None if more is None else trees):
        while len(others := others[trees.of[others] != trees.of[a]]):
            links.append((a, int(others[0])))
            trees.join(a, int(others[0]))
    return links


def _bucket_links(batches, radius: int, more: tuple[str, ...] = (), more_radius: int = 0):
    """From rows sorted by (mask, key, pair) to links between the nodes of a bucket. Buckets may span Arrow batches."""
    rest: pa.Table | None = None

    def flush(mask, key, pair, side, fp, node, *words):
        """Whole buckets, as arrays in order."""
        bucket = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))])
        several = (np.bincount(bucket) > 1)[bucket]  # a node alone has none to compare with
        if several.any():
            further = np.stack([w[several] for w in words], axis=1) if words else None
            links = np.array(tile_links(fp[several], radius, bucket[several], side[several], further, more_radius), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[several][links[:, k]]) for k in (0, 1)], ["a", "b"])

    def arrays(t: pa.Table):
        return [t.column(c).to_numpy().astype(np.int64) for c in ("mask", "key", "pair", "side")] + [t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()] + [t.column(c).to_numpy().view(np.uint64) for c in more]

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
        if not len(t):
            continue
        columns = arrays(t.combine_chunks())
        mask, key, pair = columns[:3]
        open_bucket = np.flatnonzero((mask != mask[-1]) | (key != key[-1]) | (pair != pair[-1]))
        cut = int(open_bucket[-1]) + 1 if len(open_bucket) else 0
        if cut:
            yield from flush(*(c[:cut] for c in columns))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield from flush(*arrays(rest.combine_chunks()))


def block_pairs_of(rows: DataFrame, group: list[str], id_col: str, hot: DataFrame) -> DataFrame:
    """``rows`` once for each pair of blocks they take part in, with ``pair`` and ``side`` (see near_rows).

    ``hot`` has ``group`` and ``blocks``, the number of blocks of a large group; groups that it lacks are one block.
    It is a written table, so that Spark knows its size and broadcasts it only where that is small.
    """
    blocks = F.coalesce("blocks", F.lit(1)).cast("bigint")
    own = rows.join(hot, group, "left").withColumn("block", F.pmod(F.xxhash64(id_col), blocks))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pair = F.shiftleft(F.least("block", "other"), 31) + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).cast("bigint")
    return both.select(*rows.columns, pair.alias("pair"), side.alias("side"))


def near_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``nodes`` (fp, node), fingerprints distinct, to links (a, b) that connect what is within the radius."""
    masks = block_pairs(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*[F.lit(m).cast("bigint").bitwiseAND(F.col("fp")) for m in signed])).alias("mask", "key"))
    return bucket_links(keyed, "fp", radius, block)


def bucket_links(keyed: DataFrame, deal_by: str, radius: int, block: int = BLOCK, more: tuple[str, ...] = (), more_radius: int = 0) -> DataFrame:
    """Rows (mask, key, fp, node) to links (a, b) that connect what is within the radius in a bucket (mask, key). ``more``: columns of further words, see near_rows."""
    counts = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = materialize(counts.select("mask", "key", F.ceil(F.col("n") / block).alias("blocks")), "large-buckets")
    dealt = block_pairs_of(keyed, ["mask", "key"], deal_by, hot).repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    return arrow_map(dealt, lambda batches: _bucket_links(batches, radius, more, more_radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (bigint), component_id (the smallest doc_id reachable)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    links = near_links(nodes.where("node IS NOT NULL"), radius)
    # a document that has several fingerprints (a repeated identifier) joins their nodes, whether it is a node or not
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")).where("fp <> last").select("doc_id")
    of = rows.join(several, "doc_id").join(nodes, "fp").select("doc_id", "node").distinct()
    twice = of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(twice))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
