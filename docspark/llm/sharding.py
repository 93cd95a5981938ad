"""Sharding by a k-d tree over the documents' metadata.

The tree splits recursively at weighted medians (weights: bytes; with an odd
number of leaves, at the matching quantile) along the dimension that is widest in
the node, until each leaf holds one shard's share of bytes. Medians are found by
histograms: for all nodes of a level at once, one aggregation per round gives
the weight of each of BINS equal bins, and the bin that holds the quantile is cut
into bins again until the cut is exact or within TOLERANCE of a leaf's share. The
driver sees only histogram rows, at most nodes x BINS.

Dimensions are functions of the text (byte size, CRC-32), so equal texts fall
into the same shard; only a group of equal texts above HOT of a leaf's share is
spread over shards by a hash of the row, which no partition of near equal bytes
can avoid.

Defined results: a null text has no bytes and checksum 0; null and repeated
identifiers are rows like any other; with an empty table there are no rows;
fewer rows than shards leave shards empty; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialize

ROW_BYTES = 8
BINS = 1024
ROUNDS = 6
TOLERANCE = 0.002
HOT = 0.05
#: Rows to be numbered by one task.
SLOT_ROWS = 100_000
#: dimension: bits of its values
DIMS = {"by_size": 63, "by_crc": 52}


@dataclass
class Node:
    leaves: int
    first: int
    dim: str = ""
    cut: int = 0  # rows up to this value go left
    left: Node | None = None
    right: Node | None = None


def _leaf(node: Node, number: dict[int, int], at: Column | None = None) -> Column:
    """The number of the row's open node (as a nested CASE, evaluated while scanning)."""
    if node.left is None:
        return F.lit(number[id(node)])
    return F.when(F.col(node.dim) <= node.cut, _leaf(node.left, number)).otherwise(_leaf(node.right, number))


def _open(node: Node) -> list[Node]:
    return [node] if node.left is None else _open(node.left) + _open(node.right)


def build_tree(rows: DataFrame, leaves: int, tolerance: float) -> Node:
    """The tree over ``rows`` (size and the columns of DIMS)."""
    root = Node(leaves, 0)
    spread = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = {d: max(1, (spread[f"hi_{d}"] or 0) - (spread[f"lo_{d}"] or 0)) for d in DIMS}
    while todo := [n for n in _open(root) if n.leaves > 1]:
        number = {id(n): i if n.leaves > 1 else -1 for i, n in enumerate(_open(root))}
        nodes = {number[id(n)]: n for n in todo}
        at = rows.withColumn("node", _leaf(root, number)).where("node >= 0")
        sums = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        state = {}
        for i, node in nodes.items():
            if i not in sums:  # no rows: any cut will do
                node.dim, node.cut = "by_crc", 0
                continue
            r = sums[i]
            node.dim = max(DIMS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d], d))
            want = r["w"] * (node.leaves // 2) / node.leaves
            state[i] = {"lo": r[f"lo_{node.dim}"], "hi": r[f"hi_{node.dim}"], "below": 0, "want": want}
            node.cut = state[i]["hi"]
        for _ in range(ROUNDS):
            if not state:
                break
            choose = lambda f, d=F.lit(None): _case(list(state), f)
            value = _case(list(state), lambda i: F.col(nodes[i].dim))
            lo, width = choose(lambda i: F.lit(state[i]["lo"])), choose(lambda i: F.lit(max(1, -(-(state[i]["hi"] - state[i]["lo"] + 1) // BINS))))
            inside = at.withColumn("v", value).withColumn("lo", lo).withColumn("width", width).where(F.col("v").between(F.col("lo"), choose(lambda i: F.lit(state[i]["hi"]))))
            bins = inside.groupBy("node", F.expr("(v - lo) div width").alias("bin")).agg(F.sum("size").alias("w")).collect()
            by_node: dict[int, list[tuple[int, int]]] = {}
            for b in bins:
                by_node.setdefault(b["node"], []).append((b["bin"], b["w"]))
            for i, found in by_node.items():
                s, node = state[i], nodes[i]
                step, below = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS)), s["below"]
                for b, w in sorted(found):
                    if below + w >= s["want"] or b == max(x for x, _ in found):
                        break
                    below += w
                lo = s["lo"] + b * step
                hi = min(s["hi"], lo + step - 1)
                # either end of the bin, whichever leaves less
                near_low = s["want"] - below <= below + w - s["want"]
                node.cut = lo - 1 if near_low else hi
                if step == 1 or min(abs(s["want"] - below), abs(below + w - s["want"])) <= tolerance:
                    state.pop(i)
                else:
                    state[i] = {"lo": lo, "hi": hi, "below": below, "want": s["want"]}
        for node in nodes.values():
            half = node.leaves // 2
            node.left, node.right = Node(half, node.first), Node(node.leaves - half, node.first + half)
    return root


def _case(keys: list[int], value) -> Column:
    out = F.when(F.col("node") == keys[0], value(keys[0]))
    for k in keys[1:]:
        out = out.when(F.col("node") == k, value(k))
    return out


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    # numbered once and written, so that later passes see the same numbers
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    known = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    share = (known["bytes"] or 0) / shards
    # at most shards / HOT groups can be so large: a bounded set
    hot = rows.groupBy("size", "text_crc32").agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("copies")).where((F.col("group_bytes") > HOT * share) & (F.col("copies") > 1)).select("size", "text_crc32", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), ["size", "text_crc32"], "left")
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("uid"), F.lit(1 << 20))).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("spread", spread).drop("hot")
    log_size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 1_000_000), F.lit((1 << 26) - 1)).cast("bigint")
    rows = rows.withColumn("by_size", F.shiftleft(log_size, 37) + F.shiftleft(F.shiftright("text_crc32", 15), 20) + F.col("spread"))
    rows = materialize(rows.withColumn("by_crc", F.shiftleft("text_crc32", 20) + F.col("spread")).drop("spread"), "shard-points")
    root = build_tree(rows, shards, TOLERANCE * share)
    shard = _leaf(root, {id(n): n.first for n in _open(root)})
    buckets = max(1, -(-known["n"] // (shards * SLOT_ROWS)))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    # slots: where each bucket of a shard begins, then the row's place in its bucket
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.withColumn("begin", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n")).drop("n")
    place = F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY uid) - 1")
    out = rows.withColumn("place", place).join(F.broadcast(begins), ["shard", "bucket"])  # shards x rows / SLOT_ROWS rows
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).cast("bigint").alias("slot"))
