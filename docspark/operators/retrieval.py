"""Filtered exact search, re-ranking, expansion and context.

Every list of the query path is a table with an explicit ``rank`` per query ``qid``, so one
plan answers a table of questions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.config import Prompts, Retrieval
from docspark.functions import text as X
from docspark.functions.arrow import bounded, released
from docspark.functions.vectors import TINY
from docspark.storage import materialize

#: Questions that a task may hold (a matrix of some megabytes at most).
QUERY_BLOCK = 1024
#: Rows of the index that meet a block of questions in one group, while there are few parts.
CELL_ROWS = 200_000
#: Parts and blocks that a cell is dealt into: rows are sent at most once a block, and k of them a question found at most once a part, however many there are.
MOST_PARTS, MOST_BLOCKS = 16, 8
#: Questions that a task may hold where blocks would be larger; only beyond MOST_BLOCKS times as many do blocks become more.
MOST_HELD = 8192
#: Pairs of a question and a row that are compared at once.
TILE = 2_000_000


def by_query():
    return W.partitionBy("qid")


def parse_filters(specs: list[str] | None) -> dict[str, list[str]]:
    """["key=value", ...]: values of a repeated key are alternatives."""
    out: dict[str, list[str]] = {}
    for spec in specs or []:
        key, sign, value = spec.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"a filter reads key=value: {spec!r}")
        out.setdefault(key.strip(), []).append(value.strip())
    return out


def parse_filter_rows(rows: DataFrame, specs: str = "specs") -> DataFrame:
    """Filters of a table of questions: ``rows`` (qid, specs: array of key=value) to (qid, key, alternatives), alternatives in order; a specification that reads otherwise is an error."""
    each = rows.select("qid", F.posexplode(specs).alias("place", "spec"))
    key, value = F.trim(F.regexp_extract("spec", r"(?s)^([^=]*)=", 1)), F.trim(F.regexp_extract("spec", r"(?s)^[^=]*=(.*)$", 1))
    good = F.when(key == "", F.raise_error(F.concat(F.lit("a filter reads key=value: "), "spec"))).otherwise(key)
    pairs = each.select("qid", good.alias("key"), F.struct("place", value.alias("value")).alias("x"))
    return pairs.groupBy("qid", "key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("alternatives"))


def predicate(df: DataFrame, filters: dict[str, list[str]]) -> Column:
    kinds = dict(df.dtypes)
    for key in filters:
        if kinds.get(key) != "string":
            raise ValueError(f"only string columns can be filtered: {key}")
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").isin(v) for k, v in filters.items()], F.lit(True))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; (nearly) zero rows become zero."""
    squares = (vectors * vectors).sum(axis=1, keepdims=True)
    return vectors / np.where(squares <= TINY, np.inf, np.sqrt(np.where(squares <= TINY, 1, squares)))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit rows; what is no number has none."""
    units = unit_rows(vectors)
    units[~np.isfinite(units).all(axis=1)] = 0
    return units


class Nearest:
    """The k nearest rows of each of some questions, as batches of rows come by.

    Of a question at most 2k rows are held, or those that a batch adds: what lies further away than k known rows is left out as it comes.
    """

    def __init__(self, questions: list, k: int):
        self.k, self.n, self.found, self.held = k, len(questions), [], 0
        self.worst = np.full(self.n, np.inf)  # no row further away is among the k nearest
        sizes: dict[int, list[int]] = {}
        for i, q in enumerate(questions):
            sizes.setdefault(len(q) if q is not None else 0, []).append(i)
        # by number of dimensions, as unit rows; norms are taken once
        self.matrices = {n: (np.array(ids), directions(np.array([questions[i] for i in ids], float).reshape(len(ids), n))) for n, ids in sizes.items() if n}

    def add(self, vectors: pa.ListArray, rows: pa.Table) -> None:
        order = pc.sort_indices(rows.column("chunk_id"))  # so that of equal distances the first rows count
        vectors, rows = vectors.take(order), rows.take(order)
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        units = {}
        for dims in self.matrices:
            own = np.flatnonzero(sizes == dims)
            if len(own):
                units[dims] = own, directions(vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), dims))
        step = max(1, TILE // max(1, len(vectors)))
        for a in range(0, self.n, step):
            q, r, distance = self._tile(a, min(a + step, self.n), units, len(vectors))
            if len(q):
                self.found.append(rows.take(pa.array(r)).append_column("_q", pa.array(q.astype(np.int32))).append_column("distance", pa.array(distance)))
                self.held += len(q)
        if self.held > 2 * self.k * self.n:
            self._trim()

    def _tile(self, a: int, b: int, units: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, row, distance) of the k first rows of the questions from a to b, in order, without those that are too far."""
        k, worst = self.k, self.worst[a:b]
        like = np.zeros((b - a, n))
        for dims, (own, unit) in units.items():
            which, asked = self.matrices[dims]
            low, high = np.searchsorted(which, [a, b])
            if len(own) == n and high - low == b - a:
                like = asked[low:high] @ unit.T
            else:
                like[np.ix_(which[low:high] - a, own)] = asked[low:high] @ unit.T
        least = 1 - worst
        if n > k and (new := np.flatnonzero(np.isinf(worst))).size:
            least[new] = np.partition(like[new], n - k, axis=1)[:, n - k]
        q, r = np.nonzero(like >= (least - 1e-11)[:, None])  # distances have 12 digits; ties of the last come along
        distance = np.round(1 - like[q, r], 12)
        near = distance <= worst[q]
        q, r, distance = q[near], r[near], distance[near]
        order = np.lexsort((r, distance, q))
        q, r, distance = q[order], r[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        worst[q[last]] = distance[last]
        first = place < k
        return q[first] + a, r[first], distance[first]

    def _trim(self) -> None:
        best = _first(pa.concat_tables(self.found), self.k)
        q, distance = best.column("_q").to_numpy(), best.column("distance").to_numpy()
        last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.worst[q[last]] = distance[last]
        self.found, self.held = [best], len(q)

    def result(self) -> pa.Table | None:
        return _first(pa.concat_tables(self.found), self.k) if self.found else None


def _nearest(rows: DataFrame, questions: list, k: int) -> DataFrame:
    """Of each task's rows the k nearest of each question: _q (its number), distance, and the row's columns but the vector."""
    at = rows.columns.index("embedding")
    others = [f for f in rows.schema.fields if f.name != "embedding"]
    sent = rows.sparkSession.sparkContext.broadcast([r["query"] for r in questions])

    def run(batches):
        near = Nearest(sent.value, k)
        for batch in batches:
            if batch.num_rows:
                near.add(batch.column(at), pa.Table.from_batches([batch.select([i for i in range(batch.num_columns) if i != at])]))
        if (best := near.result()) is not None:
            yield from best.select(["_q", "distance", *[f.name for f in others]]).combine_chunks().to_batches(10_000)

    schema = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("distance", T.DoubleType()), *others])
    return bounded(rows).mapInArrow(released(run), schema)


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The first k of each question by distance and chunk_id."""
    order = pc.sort_indices(rows, [("_q", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
    q = rows.column("_q").to_numpy()[order.to_numpy()]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return rows.take(order.filter(pa.array(place < k)))


def search_cells(index: DataFrame, queries: DataFrame, k: int, cell_rows: int = CELL_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """``index`` (cell, chunk_id, embedding, ...) and ``queries`` (cell, qid, query; a question may be in several cells): of each question the k nearest rows of its cells.

    One job for any number of questions. A cell's rows are dealt into parts of about ``cell_rows`` and its questions into blocks of about
    ``block``, into MOST_PARTS and MOST_BLOCKS at most, which are larger then; each part meets each block in a group of its own: rows are sent once a block, questions once a part,
    and k rows a question come from each part, so what is shuffled grows with index and questions, not with their product. In a
    task a group's questions come first and its rows stream by, so memory holds one block, of about MOST_HELD questions at most: of more than MOST_BLOCKS times as many, blocks are more. There are as many cells as centroids of the index, a bounded number, whose
    counts are broadcast.
    """
    dealt = lambda of, most: F.least(F.ceil(F.count(F.lit(1)) / of), F.lit(most))
    size = lambda df, name, n: df.groupBy("cell").agg(n.cast("int").alias(name))
    blocks = F.greatest(dealt(block, MOST_BLOCKS), F.ceil(F.count(F.lit(1)) / max(block, MOST_HELD)))
    cells = F.broadcast(materialize(size(index, "_parts", dealt(cell_rows, MOST_PARTS)).join(size(queries, "_blocks", blocks), "cell"), "cells"))
    group = F.struct("cell", "_part", "_block").alias("_group")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = [c for c in index.columns if c not in ("cell", "embedding")]
    rows = index.join(cells, "cell").withColumn("_part", deal("chunk_id", "_parts")).withColumn("_block", each("_blocks"))
    asked = queries.join(cells, "cell").withColumn("_block", deal("qid", "_blocks")).withColumn("_part", each("_parts"))
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    kinds = {"qid": queries.schema["qid"].dataType, "row": index.select(row.alias("row")).schema["row"].dataType}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    single = all(dict(df.dtypes)[c] == "array<float>" for df, c in ((index, "embedding"), (queries, "query")))
    vector = lambda c: F.col(c).cast("array<float>" if single else "array<double>").alias("vector")
    both = asked.select(group, F.lit(0).alias("_side"), "qid", vector("query"), none("row"))
    both = both.unionByName(rows.select(group, F.lit(1).alias("_side"), none("qid"), vector("embedding"), row.alias("row")))
    sorted_ = both.repartition("_group").sortWithinPartitions("_group", "_side")

    def run(batches):
        now, asked, names, near = None, [], [], None

        def done():
            if near is not None and (best := near.result()) is not None:
                qid = pa.chunked_array(names).combine_chunks().take(best.column("_q").combine_chunks())
                yield from pa.table([qid, best.column("distance"), best.column("row")], ["qid", "distance", "row"]).combine_chunks().to_batches(10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in (*batch.column(0).flatten(), batch.column(1))])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                *of, side = key[:, a].tolist()
                if of != now:
                    yield from done()
                    now, asked, names, near = of, [], [], None
                part = batch.slice(a, b - a)
                if side == 0:
                    asked += part.column(3).to_pylist()
                    names.append(part.column(2))
                    continue
                if near is None:
                    near = Nearest(asked, k)
                row = part.column(4)
                near.add(part.column(3), pa.table([row, row.field("chunk_id")], ["row", "chunk_id"]))
        yield from done()

    schema = T.StructType([T.StructField("qid", kinds["qid"]), T.StructField("distance", T.DoubleType()), T.StructField("row", kinds["row"])])
    found = bounded(sorted_).mapInArrow(released(run), schema).select("qid", "distance", "row.*")
    near = W.partitionBy("qid").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def knn(index: DataFrame, queries: DataFrame, k: int, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """``index`` (chunk_id, embedding, ...) and ``queries`` (qid, query): the k nearest per query by cosine distance, all columns.

    Exact: filters reach the scan; each task multiplies batches of vectors with the questions'
    matrix and keeps the k nearest of each question, and these are ranked. Distances are rounded to 12
    digits and ties go by chunk_id. A vector that is null, zero or of another length has distance 1. Up to QUERY_BLOCK
    questions are sent to all tasks, and the index is not shuffled; more go by ``search_cells``, as one cell, with equal results.
    """
    if filters:
        index = index.where(predicate(index, filters))
    near = W.partitionBy("_q").orderBy("distance", "chunk_id")
    questions = queries.limit(QUERY_BLOCK + 1).collect()
    if len(questions) > QUERY_BLOCK:
        return search_cells(index.withColumn("cell", F.lit(0)), queries.select("qid", "query", F.lit(0).alias("cell")), k, block=QUERY_BLOCK).withColumn("score", -F.col("distance"))
    if not questions:
        return index.limit(0).join(queries.select("qid").limit(0)).drop("embedding").select(F.lit(0.0).alias("distance"), *[c for c in index.columns if c != "embedding"], F.lit(0).alias("rank"), "qid", F.lit(0.0).alias("score"))
    names = index.sparkSession.createDataFrame([(i, r["qid"]) for i, r in enumerate(questions)], T.StructType([T.StructField("_q", T.IntegerType()), queries.schema["qid"]]))
    found = _nearest(index, questions, k).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return found.join(F.broadcast(names), "_q").drop("_q").withColumn("score", -F.col("distance"))  # of QUERY_BLOCK rows at most


def capped_top(ranked: DataFrame, cap: int, k: int, source: str = "source_id") -> DataFrame:
    """The first k rows of which at most ``cap`` share a source; no cap if it is not positive."""
    if cap > 0:
        ranked = ranked.withColumn("_own", F.row_number().over(W.partitionBy("qid", source).orderBy("rank"))).where(F.col("_own") <= cap).drop("_own")
    return ranked.withColumn("rank", F.row_number().over(by_query().orderBy("rank"))).where(F.col("rank") <= k)


def soft_cap(ranked: DataFrame, cap: int, source: str = "source_id") -> DataFrame:
    """Rows beyond ``cap`` of a source move behind all others, in order."""
    if cap <= 0:
        return ranked
    own = F.row_number().over(W.partitionBy("qid", source).orderBy("rank"))
    return ranked.withColumn("_over", (own > cap).cast("int")).withColumn("rank", F.row_number().over(by_query().orderBy("_over", "rank"))).drop("_over")


def redundancy(ranked: DataFrame, k: int, source: str = "source_id") -> DataFrame:
    """(qid, redundancy): share of the most frequent source among the first k."""
    counts = ranked.where(F.col("rank") <= k).groupBy("qid", source).count()
    return counts.groupBy("qid").agg((F.max("count") / F.sum("count")).alias("redundancy"))


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy: nearest first, then most relevant less most like what is chosen; the earliest of equals (to 12 digits)."""
    unit = lambda v: v / np.where((n := np.sqrt((v * v).sum(-1, keepdims=True))) ** 2 <= 1e-12, np.inf, n)
    query, vectors = unit(query), unit(vectors)
    gain, like = vectors @ query, None
    chosen: list[int] = []
    while len(chosen) < min(k, len(vectors)):
        score = np.round(gain if like is None else weight * gain - (1 - weight) * like, 12)
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
        now = vectors @ vectors[chosen[-1]]
        like = now if like is None else np.maximum(like, now)
    return chosen


def mmr(ranked: DataFrame, queries: DataFrame, k: int, weight: float = 0.7, pool: int = 50) -> DataFrame:
    """Re-ranks the first ``pool`` of each query (``ranked`` with embedding); score 1 - 0.001 a place. Rows without a vector go."""
    rows = ranked.where((F.col("rank") <= pool) & F.col("embedding").isNotNull()).join(queries, "qid")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        order = mmr_order(np.array(pdf["query"].iloc[0], float), np.array(pdf["embedding"].tolist(), float), k, weight)
        out = pdf.iloc[order].drop(columns="query")
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        out["score"] = np.maximum(0.0, 1 - 0.001 * np.arange(len(out)))
        return out

    return rows.groupBy("qid").applyInPandas(each, ranked.schema)


def expand_neighbors(seeds: DataFrame, store: DataFrame, depth: int, use_prev: bool = True, use_next: bool = True) -> DataFrame:
    """Adds prev/next chunks of the frontier, ``depth`` times; score less 0.05 a step, not below 0.

    ``seeds``: qid, chunk_id, rank, score, prev_id, next_id. Of rows that lead to a chunk the best-scored
    counts, the last of equals. Gives ``seeds`` and new rows with origin, expanded_from, expanded_depth.
    """
    have = seeds.withColumn("origin", F.lit("seed")).withColumn("expanded_from", F.lit(None).cast("string")).withColumn("expanded_depth", F.lit(None).cast("int"))
    if depth <= 0 or not (use_prev or use_next):
        return have
    columns = ["qid", "chunk_id", "rank", "score", "prev_id", "next_id", "origin", "expanded_from", "expanded_depth"]
    have = frontier = materialize(have.select(columns), "seeds")
    links = store.select("chunk_id", "prev_id", "next_id")
    for d in range(1, depth + 1):
        targets = F.array(*([F.struct(F.lit(0).alias("side"), F.col("prev_id").alias("id"))] if use_prev else []), *([F.struct(F.lit(1).alias("side"), F.col("next_id").alias("id"))] if use_next else []))
        to = frontier.select("qid", F.col("chunk_id").alias("from_id"), "rank", "score", F.explode(targets).alias("t")).where("trim(t.id) <> ''").withColumn("to_id", F.col("t.id"))
        best = to.groupBy("qid", "to_id").agg(F.max_by(F.struct("from_id", "score", "rank", F.col("t.side").alias("side")), F.struct("score", "rank")).alias("b"))
        fresh = best.join(have.select("qid", F.col("chunk_id").alias("to_id")), ["qid", "to_id"], "left_anti")
        found = fresh.join(links.withColumnRenamed("chunk_id", "to_id"), "to_id")
        base = have.groupBy("qid").agg(F.max("rank").alias("base"))
        order = F.row_number().over(by_query().orderBy("b.rank", "b.side", "to_id"))
        frontier = found.join(base, "qid").select("qid", F.col("to_id").alias("chunk_id"), (F.col("base") + order).cast("int").alias("rank"), F.greatest(F.lit(0.0), F.col("b.score") - 0.05 * d).alias("score"), "prev_id", "next_id", F.lit("expanded").alias("origin"), F.col("b.from_id").alias("expanded_from"), F.lit(d).alias("expanded_depth"))
        frontier = materialize(frontier, "frontier")  # read by the next step and by the result
        have = have.unionByName(frontier)
    return have


def expand_parents(rows: DataFrame, store: DataFrame, most: int) -> DataFrame:
    """One parent per source, of its best-scored row (first of equals), at most ``most`` a query; score less 0.03.

    ``rows``: qid, chunk_id, rank, score, source_id, parent_id.
    """
    child = rows.where("trim(coalesce(parent_id, '')) <> '' AND coalesce(source_id, '') <> ''").join(rows.select("qid", F.col("chunk_id").alias("parent_id")), ["qid", "parent_id"], "left_anti")
    best = child.withColumn("_n", F.row_number().over(W.partitionBy("qid", "source_id").orderBy(F.desc("score"), "rank"))).where("_n = 1").drop("_n")
    best = best.withColumn("_n", F.row_number().over(by_query().orderBy(F.desc("score"), "rank"))).where(F.col("_n") <= most)
    return best.join(store.select(F.col("chunk_id").alias("parent_id")), "parent_id").select("qid", F.col("parent_id").alias("chunk_id"), F.col("_n").alias("place"), F.greatest(F.lit(0.0), F.col("score") - 0.03).alias("score"), "source_id", F.col("chunk_id").alias("expanded_from"), F.lit(1).alias("expanded_depth"))


def by_score(rows: DataFrame) -> DataFrame:
    """Stable order by score, highest first."""
    return rows.withColumn("rank", F.row_number().over(by_query().orderBy(F.desc("score"), "rank")))


def context_block(label: Column, row: dict[str, Column]) -> Column:
    """A passage under its label: source_id, filename, nature, ext, unit, chunk_id and text; null fields are empty."""
    text = lambda c: F.coalesce(row[c].cast("string"), F.lit(""))
    unit = F.concat_ws(" ", text("unit_type_start"), X.to_int(row["unit_index_start"]).cast("string"))
    fields = [("source_id", text("source_id")), ("filename", text("filename")), ("nature", text("nature")), ("ext", text("ext")), ("unit", unit), ("chunk_id", text("chunk_id"))]
    return F.concat(F.lit("[C"), label.cast("string"), F.lit("]\n"), *[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\n"))], F.lit("text:\n"), text("text"), F.lit("\n"))


def prompt_overhead(query: Column, prompts: Prompts) -> Column:
    """Tokens of the fixed prompts around a question."""
    parts = [F.lit(prompts.system), F.concat(F.lit(prompts.before), query, F.lit(prompts.after)), F.lit(prompts.closing)]
    return X.token_count(F.concat_ws("\n", *parts))


def within_budget(ranked: DataFrame, budget: int | Column, tokens: str = "tokens") -> DataFrame:
    """The longest prefix of each query that fits the budget, the first row always. Adds used (running).

    Nothing follows a first row that is over the budget, or a row that fills it.
    """
    used = F.sum(tokens).over(by_query().orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))


def context_budget(config: Retrieval, overhead: int | Column) -> int | Column:
    limit = config.resolved("context_tokens")
    least = min(300, limit)
    return max(least, limit - overhead) if isinstance(overhead, int) else F.greatest(F.lit(least), F.lit(limit) - overhead)


#: Of a chunk's metadata, what answers and context show. Missing columns count as empty.
SHOWN = ("source_id", "filename", "nature", "ext", "origin_path", "unit_type_start", "unit_index_start", "unit_type_end", "unit_index_end", "start_char", "end_char", "text")


def retrieve(queries: DataFrame, index: DataFrame, store: DataFrame, config: Retrieval = Retrieval(), overhead: int = 0) -> DataFrame:
    """The whole query path: search, (re-rank), cap, expand, rank, soft cap, context.

    ``queries``: qid, query, and question if the prompts around it are to be counted. ``index``: chunk_id, embedding and string metadata. ``store``: chunks of both levels.
    What several steps read (the seeds, each step of expansion, the candidates) is written once, so no step computes the search again.
    """
    k, cap = config.resolved("top_k"), config.resolved("per_source")
    links = store.select("chunk_id", "source_id", "prev_id", "next_id", "parent_id")
    found = knn(index.select("chunk_id", "embedding", *config.filters, *(["source_id"] if "source_id" not in config.filters else [])), queries, config.initial_k, config.filters)
    if config.score_mode == "similarity":
        found = found.withColumn("score", 1 - F.col("distance"))
    if config.mmr:
        found = materialize(found, "found")
        again = redundancy(found, k).where(F.col("redundancy") >= config.mmr_gate).select("qid")
        pool = min(config.initial_k, 50)
        vectors = index.select("chunk_id", "embedding")
        reranked = mmr(found.join(again, "qid", "left_semi").join(vectors, "chunk_id", "left"), queries.select("qid", "query"), min(pool, 2 * k), config.mmr_lambda, pool).drop("embedding")
        found = found.join(again, "qid", "left_anti").unionByName(reranked)
    seeds = capped_top(found, cap, k).select("qid", "chunk_id", "rank", "score", "distance")
    seeds = materialize(seeds.join(links, "chunk_id"), "found")
    rows = expand_neighbors(seeds, links, config.neighbor_depth, config.use_prev, config.use_next).select("qid", "chunk_id", "rank", "score", "origin", "expanded_from", "expanded_depth")
    if config.resolved("parents") and config.max_parents:
        full = rows.join(links.select("chunk_id", "source_id", "parent_id"), "chunk_id")
        last = rows.groupBy("qid").agg(F.max("rank").alias("base"))
        parents = expand_parents(full, links, config.max_parents).join(last, "qid").select("qid", "chunk_id", (F.col("base") + F.col("place")).cast("int").alias("rank"), "score", F.lit("expanded").alias("origin"), "expanded_from", "expanded_depth")
        rows = rows.unionByName(parents)
    shown = store.select("chunk_id", *[F.col(c) if c in store.columns else F.lit("").alias(c) for c in SHOWN])
    rows = by_score(materialize(rows, "candidates").join(shown, "chunk_id"))
    if config.soft_cap:
        rows = soft_cap(rows, cap)
    rows = rows.join(seeds.select("qid", "chunk_id", F.col("score").alias("retrieval_score"), "distance"), ["qid", "chunk_id"], "left")
    rows = rows.withColumn("block", context_block(F.col("rank"), {c: F.col(c) for c in ("chunk_id", *SHOWN)}))
    budget: int | Column = context_budget(config, overhead)
    if "question" in queries.columns:
        rows = rows.join(queries.select("qid", prompt_overhead(F.col("question"), config.prompts).alias("_overhead")), "qid")
        budget = context_budget(config, F.col("_overhead") + overhead)
    return within_budget(rows.withColumn("tokens", X.token_count(F.col("block"))), budget).drop("_overhead")
