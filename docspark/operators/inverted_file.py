"""An inverted file of vectors: each row lies in the cell of its nearest centroid, and a search looks into the nearest cells.

Centroids are fitted on a bounded sample; every row is indexed. Within the cells it looks into a search is
exact, by ``retrieval.search_cells``: all questions in one job, large cells in parts. A hot cell costs more tasks, not a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators.retrieval import predicate, search_cells, unit_rows

#: Rows that centroids are fitted on, and most centroids (a bound on both, whatever the index holds).
SAMPLE, MOST_CENTROIDS = 65_536, 4096
ITERATIONS = 8
#: How many cells a search looks into is set when the index is fitted: so many that TARGET of the TRIED questions' NEIGHBORS nearest in the sample are found.
TARGET, TRIED, NEIGHBORS = 0.95, 512, 24
#: The cell of rows that have no direction: null, zero, or of another length than the centroids.
NO_CELL = -1


@dataclass(frozen=True)
class Centroids:
    """Unit vectors, and the number of cells that a search looks into."""

    vectors: np.ndarray
    probed: int


def fit(index: DataFrame, n: int | None = None, vector_col: str = "embedding", key: str = "chunk_id") -> Centroids:
    """Unit centroids: about the root of the number of rows, spherical k-means over at most SAMPLE rows, those of the smallest key hashes; no rows for an index without vectors.

    Vectors of the commonest length count.
    """
    sizes = index.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return Centroids(np.zeros((0, 0)), 1)
    rows = index.where(F.size(vector_col) == sizes["d"]).select(F.col(vector_col).alias("v"), F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    taken = rows.orderBy("h", "k").limit(SAMPLE).collect()
    x = unit_rows(np.array([r["v"] for r in taken], float))
    n = min(n or max(1, round(sizes["count"] ** 0.5)), MOST_CENTROIDS, len(x))
    centroids = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ITERATIONS):
        of = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids = np.where((np.bincount(of, minlength=n) > 0)[:, None], unit_rows(sums), centroids)
    return Centroids(centroids, _probes(x, centroids))


def _probes(x: np.ndarray, centroids: np.ndarray) -> int:
    """How many of the nearest cells hold TARGET of the nearest neighbours of some of the sample.

    Neighbours in a sample lie further away than those in the whole, so the whole is rather searched better.
    """
    like = x[:TRIED] @ x.T
    like[np.arange(len(like)), np.arange(len(like))] = -np.inf  # not itself
    near = np.argsort(-like, axis=1, kind="stable")[:, : min(NEIGHBORS, len(x) - 1)]
    of = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(-(x[:TRIED] @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1 if len(needed) else 1


def _cells(df: DataFrame, vector_col: str, centroids: np.ndarray, n: int) -> DataFrame:
    """``df`` with ``cells``: the n nearest cells of each row's vector."""
    at, names = df.columns.index(vector_col), [*df.columns, "cells"]
    sent = df.sparkSession.sparkContext.broadcast(centroids)  # MOST_CENTROIDS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            vectors, out = batch.column(at), [[NO_CELL]] * batch.num_rows
            own = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == centroids.shape[1]) if len(centroids) else []
            if len(own):
                flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                units = unit_rows(np.nan_to_num(flat))
                near = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :n]
                for i, cells, directed in zip(own.tolist(), near.tolist(), (units != 0).any(axis=1).tolist()):
                    out[i] = cells if directed else [NO_CELL]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def build(index: DataFrame, path: str, centroids: Centroids | None = None) -> Centroids:
    """Writes all of ``index`` (chunk_id, embedding, ...) by cell under ``path``; gives the centroids, which are written too."""
    centroids = fit(index) if centroids is None else centroids
    rows = _cells(index, "embedding", centroids.vectors, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    # a cell goes to some tasks, so that a hot one is no large task
    rows.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    spark = index.sparkSession
    spark.createDataFrame([(i, c.tolist(), centroids.probed) for i, c in enumerate(centroids.vectors)], "cell int, centroid array<double>, probed int").coalesce(1).write.parquet(f"{path}/centroids")
    return centroids


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, filters: dict[str, list[str]] | None = None, probed: int | None = None) -> DataFrame:
    """``queries`` (qid, query): the k nearest of the ``probed`` nearest cells, as ``retrieval.knn`` gives them.

    Only the files of cells that some question looks into are read. A question without direction looks into all rows without one.
    """
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    centroids = np.array([r["centroid"] for r in found]) if found else np.zeros((0, 0))
    probed = probed or (found[0]["probed"] if found else 1)
    asked = _cells(queries.select("qid", "query"), "query", centroids, probed)
    asked = asked.select("qid", "query", F.explode(F.array_distinct(F.concat("cells", F.array(F.lit(NO_CELL))))).alias("cell"))
    index = spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("int"))
    if filters:
        index = index.where(predicate(index, filters))
    return search_cells(index, asked, k).withColumn("score", -F.col("distance"))
