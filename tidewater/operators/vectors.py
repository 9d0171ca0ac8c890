"""Exact nearest neighbours, centroid ranking and k-means."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import batch_matrix, best_of, blocks, matrix, nearest, partial_topk
from .positions import global_position

#: Partial sums of one k-means step that the driver adds up itself.
SUMS_BYTES = 64 << 20


def sample_queries(vectors: DataFrame, count: int, order: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, embedding): the vectors at positions 0, s, 2s, ... with s = floor(N / count)."""
    n = vectors.count()
    if not 0 < count <= n:
        raise ValueError(f"{count} queries asked of {n} vectors")
    stride = n // count
    # ids alone are ranked; the `count` chosen ones then fetch their vectors
    p = global_position(vectors.select(order), order, "_p")
    keep = p.filter((F.col("_p") % stride == 0) & (F.floor(F.col("_p") / stride) < count))
    keep = keep.select(F.floor(F.col("_p") / stride).alias("query_id"), order)
    return vectors.join(F.broadcast(keep), order).select("query_id", "vec_id", "embedding")


def brute_force_knn(vectors: DataFrame, queries: DataFrame, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, dist), smallest (dist, vec_id) first; query_id is compared with vec_id to exclude self.

    Each partition of vectors yields its own k best, so what is shuffled is k rows a query and partition.
    """
    parts = [(ids, mat) for ids, mat in (matrix(b, "query_id", "embedding") for b in blocks(queries, "query_id", "embedding")) if len(ids)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (
        reduce(DataFrame.unionByName, (partial_topk(vectors, ids, mat, k, ids if exclude_self else None) for ids, mat in parts))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "dist")
    )


def first_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(cluster_id, centroid) of the k vectors with the lowest ids."""
    low = vectors.orderBy("vec_id").limit(k)
    w = Window.orderBy("vec_id")
    return low.select((F.row_number().over(w) - 1).cast("bigint").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))


def top_centroids(queries: DataFrame, centroids: DataFrame, nprobe: int = 10) -> DataFrame:
    """(query_id, rank, cluster_id, dist) in the order (dist, cluster_id)."""
    ids, mat = matrix(centroids, "cluster_id", "centroid")
    return nearest(queries, ids, mat, "query_id", nprobe, "cluster_id")


def pad_probes(probes: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, rank, cluster_id) with nprobe rows a query; -1 where there are fewer clusters."""
    ranks = F.explode(F.sequence(F.lit(1), F.lit(nprobe))).alias("rank")
    every = probes.select("query_id").distinct().select("query_id", ranks)
    return every.join(probes.select("query_id", "rank", "cluster_id"), ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster_id, dist) of the nearest centroid, lowest id on ties."""
    ids, mat = matrix(centroids, "cluster_id", "centroid")
    return nearest(vectors, ids, mat, "vec_id", 1, "cluster_id").drop("rank")


def _lloyd_step(train: DataFrame, mat: np.ndarray, partitions: int) -> np.ndarray:
    """New means; each partition sends one row of sums a cluster, and the rows of a cluster are added up in one place.

    That place is the driver if the rows of all partitions stay below SUMS_BYTES, else a task for each part of the clusters.
    """
    handle = train.sparkSession.sparkContext.broadcast(mat)
    k, dim = mat.shape

    def rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(counts)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(sums[hit].ravel()), dim).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit]), flat], names=["cluster_id", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = handle.value
        sums, counts = np.zeros((k, dim)), np.zeros(k, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = batch_matrix(b, "embedding")
                best = best_of(x, mat, 1)[0][:, 0]
                ok = best >= 0
                np.add.at(sums, best[ok], x[ok])
                counts += np.bincount(best[ok], minlength=k)
        yield rows(sums, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                at = np.asarray(b.column(0))
                np.add.at(sums, at, batch_matrix(b, "s"))
                np.add.at(counts, at, np.asarray(b.column(1)))
        yield rows(sums, counts)

    schema = "cluster_id bigint, n bigint, s array<double>"
    parts = train.select("embedding").mapInArrow(run, schema)
    if partitions * k * dim * 8 > SUMS_BYTES:
        parts = parts.repartition("cluster_id").mapInArrow(add, schema)  # k rows
    out, n = np.zeros((k, dim)), np.zeros(k, dtype=np.int64)
    for r in parts.collect():
        out[r.cluster_id] += np.array(r.s)
        n[r.cluster_id] += r.n
    out[n > 0] /= n[n > 0, None]
    handle.unpersist()
    return out


def lowest(vectors: DataFrame, count: int) -> DataFrame:
    """The vectors with the `count` lowest ids. Ids alone are ranked; the last of them then is a filter on the table."""
    last = global_position(vectors.select("vec_id"), "vec_id", "_p").filter(F.col("_p") == count - 1).first() if count > 0 else None
    return vectors.filter(F.col("vec_id") <= last["vec_id"]) if last else vectors.filter(F.lit(False))


def kmeans(vectors: DataFrame, k: int, iters: int = 20, train_fraction: float = 0.5) -> DataFrame:
    """(cluster_id, centroid) after exactly iters Lloyd steps.

    Starts from the k lowest ids, trains on the floor(N*f) lowest ids; an empty cluster becomes the zero vector.
    """
    n = vectors.count()
    if n < k:
        raise ValueError(f"{k} clusters asked of {n} vectors")
    train = lowest(vectors, int(n * train_fraction)).select("embedding").persist()
    try:
        _, mat = matrix(first_vectors(vectors, k), "cluster_id", "centroid")
        partitions = train.rdd.getNumPartitions()
        for _ in range(iters):
            mat = _lloyd_step(train, mat, partitions)
    finally:
        train.unpersist()
    rows = [(i, [float(x) for x in m]) for i, m in enumerate(mat)]
    return vectors.sparkSession.createDataFrame(rows, "cluster_id bigint, centroid array<double>")


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row queries, recall: the share of true (query_id, vec_id) pairs among the found."""
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("h")), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("h", F.lit(0))).alias("recall"))
