"""SimHash near-duplicates at a similarity of word shingles: tiles of fingerprints propose, the shingles decide.

A text is the set of its shingles of five words (XXH64; lowered and split as for SimHash). Two texts are linked if
their sets share LEAST or more of what they have together. At a similarity of 0.8 a bit of two fingerprints differs with a chance of
0.15 (0.19 for sets of four and five, 0.161 at most for others), so 64 bits lie ten apart on average: no exact split of so few into
blocks finds them. So fingerprints are WORDS words wide, each the majority of the set's hashes, mixed anew for each word after the first, and
their bits are cut into keys of KEY bits (64 keys, 93 for sets of SMALL shingles and less). Sets that agree on a key are in one bucket, and buckets
are compared tile by tile (simhash.bucket_links): RADIUS bits of the first word, then WIDE bits of the next MORE words. A pair of 0.8
agrees on no key with a chance of (1 - 0.85 ** 11) ** 64, about 1e-5 (5e-5 at most, as for sets of four and five or of 15); the radii lose
1e-5 of sets of four and five, 1e-7 of others. Sets that have nothing in common are compared if they share a key;
of those pairs 1.9e-7 pass the radii (2e-8 of pairs that share none). As n ** 2 / 64 pairs of n texts are compared, a text has one such chance
link on average at some 1.7e8 texts: far below that chance links are few and only cost counting, from there on they make one candidate component of most texts.

The components of these links are candidates. In each, pairs whose first words are within RADIUS are counted exactly. A component gives a spanning forest of its links, not the pairs.

Equal sets are one node. A candidate component of more than BLOCK shingles is dealt by a hash of the document into blocks, and
each pair of blocks is compared by itself, so a task holds the shingle hashes of two blocks at most (one text may be longer).
A document goes to as many pairs as its component has blocks.

Defined results: texts without words (null too) are alike; shorter texts than a shingle are one shingle; rows with
a null identifier are left out; rows that repeat an identifier are the same document; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, materialize
from docspark.llm.components import components
from docspark.llm.simhash import BLOCK as BUCKET
from docspark.llm.simhash import Trees, block_pairs_of, bucket_links, majority, near_rows, shingle_hashes

SHINGLE, LEAST = 5, 0.8
#: Words of a fingerprint and bits of a key; sets of SMALL shingles and less have fingerprints of SMALL_WORDS.
WORDS, KEY = 11, 11
SMALL, SMALL_WORDS = 5, 16
#: Bits that near copies differ in at most: of the first word, and of the MORE words after it.
RADIUS, MORE, WIDE = 28, 3, 60
#: Shingles of a candidate component that one task compares with each other; larger ones go in pairs of blocks.
BLOCK = 1 << 21
_WORD_COLUMNS = ["fp", *(f"fp{k}" for k in range(1, 1 + MORE))]
_STEPS = np.arange(SMALL_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes in order; a single 0 for a text without words."""
    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` hashes for each hash, itself the first; the others are steps of splitmix64 from it."""
    x = hashes[:, None] + _STEPS[:words]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of the fingerprint, 64 for each word: the first word is majority(hashes)."""
    words = SMALL_WORDS if len(hashes) <= SMALL else WORDS
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):  # as many as a byte counts
        part = _mixed(hashes[i : i + 255], words).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * counts > len(hashes)


def bit_keys(bits: np.ndarray) -> np.ndarray:
    """The keys of a fingerprint, in order; bits left over are in none."""
    n = len(bits) // KEY
    return (bits[: n * KEY].reshape(n, KEY) @ (1 << np.arange(KEY))).astype(np.int32)


def exact_links(ids: list[int], sets: list[np.ndarray], least: float = LEAST, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``: each is counted against those of other trees (and sides, see near_rows) with a near fingerprint."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], ends[:-1])
    marked, links, trees = np.zeros(int(ends[-1]), np.int64), [], Trees(len(sets))
    for same in np.split(order := np.argsort(ids, kind="stable"), np.flatnonzero(np.diff(np.array(ids)[order])) + 1):
        for b in same[1:]:  # sets of one document are of one tree
            trees.join(int(same[0]), int(b))
    for a, others in near_rows(np.array([majority(s) for s in sets], np.uint64), RADIUS, side=None if sides is None else np.array(sides)):
        others = others[trees.of[others] != trees.of[a]]
        if not len(others):
            continue
        marked[codes[a]] = 1
        n = sizes[others]
        common = np.add.reduceat(marked[np.concatenate([codes[b] for b in others])], np.cumsum(n) - n)
        marked[codes[a]] = 0
        for b in others[common + 1e-9 >= least * (sizes[a] + n - common)].tolist():
            if trees.of[a] != trees.of[b]:
                links.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
                trees.join(a, b)
    return links


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            digests, keys, words, sizes = [], [], [], []
            for t in batch.column(1):
                hashes = shingle_set(t.as_py(), shingle)
                bits = wide_bits(hashes)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                keys.append(bit_keys(bits))
                words.append(np.packbits(bits[: 64 * (1 + MORE)], bitorder="little").view("<i8"))
                sizes.append(len(hashes))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int32)))
            columns = np.array(words, np.int64).reshape(-1, 1 + MORE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), lists, *(pa.array(columns[:, k]) for k in range(1 + MORE)), pa.array(sizes, pa.int64())],
                ["doc_id", "digest", "keys", *_WORD_COLUMNS, "size"],
            )

    return arrow_map(docs, run, f"doc_id bigint, digest binary, keys array<int>, {', '.join(f'{c} bigint' for c in _WORD_COLUMNS)}, size bigint")


def candidate_links(nodes: DataFrame, block: int = BUCKET) -> DataFrame:
    """``nodes`` (node, keys, words of the fingerprint) to links (a, b) that connect the candidates."""
    keyed = nodes.select("node", *_WORD_COLUMNS, F.posexplode("keys").alias("mask", "key"))
    return bucket_links(keyed, "node", RADIUS, block, tuple(_WORD_COLUMNS[1:]), WIDE)


def _compare(batches, shingle: int, least: float):
    """From rows (component, pair, side, doc_id, text) in order of component and pair to exact links; these may span Arrow batches."""
    now, ids, sets, sides, seen = None, [], [], [], set()

    def flush():
        links = np.array(exact_links(ids, sets, least, sides) if len(ids) > 1 else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        for component, pair, side, doc, text in zip(*(batch.column(i) for i in range(5))):
            group, doc = (component.as_py(), pair.as_py()), doc.as_py()
            if group != now:
                if len(ids) > 1:
                    yield flush()
                now, ids, sets, sides, seen = group, [], [], [], set()
            hashes = shingle_set(text.as_py(), shingle)
            what = doc, xxhash.xxh3_128_digest(hashes.tobytes())
            if what not in seen:
                seen.add(what)
                ids.append(doc)
                sets.append(hashes)
                sides.append(side.as_py())
    if len(ids) > 1:
        yield flush()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs`` with an identifier: doc_id, component_id (the smallest doc_id reachable)."""
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id IS NOT NULL")
    rows = materialize(_signatures(docs, shingle), "shingle-signatures")
    nodes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("keys", *_WORD_COLUMNS, "size"))), "shingle-nodes")
    candidates = components(candidate_links(nodes))
    sizes = candidates.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.ceil(F.sum("size") / block).alias("blocks"))
    dealt = block_pairs_of(candidates, ["component"], "node", materialize(sizes.where("blocks > 1"), "large-candidates"))
    dealt = docs.join(dealt, docs["doc_id"] == dealt["node"]).select("component", "pair", "side", "doc_id", "text")
    dealt = dealt.repartition("component", "pair").sortWithinPartitions("component", "pair", "doc_id")
    links = arrow_map(dealt, lambda batches: _compare(batches, shingle, least), "a bigint, b bigint")
    same = rows.join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    # a document with several sets (a repeated identifier) joins their nodes
    found = components(links.unionByName(same.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    return same.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
