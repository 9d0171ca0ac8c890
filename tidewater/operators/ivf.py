"""Inverted-file index over flat vectors: build, offsets, statistics, search."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import blocks, matrix, partial_topk
from .vectors import assign, top_centroids

ID_BLOCK = 1 << 20


def build_index(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, pos, vec_id, embedding), pos in the order (cluster_id, vec_id).

    Positions are ranked inside blocks of ids of one cluster, so a large cluster is not one task; the totals of
    a cluster's blocks are summed in the cluster, and only the totals of the clusters meet in one window.
    """
    a = assign(vectors, centroids).select("vec_id", "cluster_id", F.floor(F.col("vec_id") / ID_BLOCK).alias("b"))
    counts = a.groupBy("cluster_id", "b").agg(F.count("*").alias("c"))
    within = Window.partitionBy("cluster_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)  # k rows
    whole = counts.groupBy("cluster_id").agg(F.sum("c").alias("t")).select("cluster_id", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("first"))
    inside = counts.withColumn("before", F.coalesce(F.sum("c").over(within), F.lit(0)))
    starts = inside.join(whole, "cluster_id").select("cluster_id", "b", (F.col("first") + F.col("before")).alias("o"))
    inner = Window.partitionBy("cluster_id", "b").orderBy("vec_id")
    placed = a.join(starts, ["cluster_id", "b"]).withColumn("pos", F.col("o") + F.row_number().over(inner) - 1)
    return placed.join(vectors, "vec_id").select("cluster_id", "pos", "vec_id", "embedding")


def sample_clustered(index: DataFrame, count: int) -> DataFrame:
    """(query_id, vec_id, embedding): the vectors at places 0, s, 2s, ... of the cluster-sorted order, s = floor(N / count)."""
    n = index.count()
    if not 0 < count <= n:
        raise ValueError(f"{count} queries asked of {n} vectors")
    stride = n // count
    return index.filter(F.expr(f"pos % {stride} = 0 AND pos div {stride} < {count}")).select(F.expr(f"pos div {stride}").alias("query_id"), "vec_id", "embedding")


def cluster_sizes(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, size) of every cluster, empty ones too."""
    n = index.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return centroids.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).alias("size"))


def cluster_offsets(sizes: DataFrame, k: int) -> DataFrame:
    """(cluster_id, offset, size) and an end row k; empty clusters keep the running offset."""
    w = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)  # k rows
    rows = sizes.select("cluster_id", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("offset"), "size")
    end = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("offset"))
    return rows.unionByName(end.select(F.lit(k).cast("bigint").alias("cluster_id"), "offset", F.lit(0).cast("bigint").alias("size")))


def cluster_stats(sizes: DataFrame) -> DataFrame:
    """One row min, q1, median, q3, max, avg, empty; quartiles are medians of the halves, avg divides integers."""
    w = Window.orderBy("size", "cluster_id")  # k rows
    r = sizes.select("size", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    return r.agg(
        F.min("size").alias("min"),
        F.median(F.when(F.col("r") <= F.floor(F.col("n") / 2), F.col("size"))).alias("q1"),
        F.median("size").alias("median"),
        F.median(F.when(F.col("r") > F.ceil(F.col("n") / 2), F.col("size"))).alias("q3"),
        F.max("size").alias("max"),
        F.floor(F.sum("size") / F.count("*")).alias("avg"),
        F.count_if(F.col("size") == 0).alias("empty"),
    )


def search_trace(index: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int, dim: int, threads: int = 32) -> DataFrame:
    """(block, thread, seq, index): the reads of the vector array by a search, a block of threads for each query.

    Clusters are read nearest first, vectors by position, and the elements of a vector are taken in turn.
    """
    probes = top_centroids(queries, centroids, nprobe).select("query_id", "cluster_id", "rank")
    rows = index.select("cluster_id", "pos").join(F.broadcast(probes), "cluster_id")  # nprobe rows a query
    each = rows.select("query_id", "rank", "pos", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("e"))
    at = F.col("pos") * dim + F.col("e")
    seq = F.struct("query_id", "rank", "pos", "e")
    return each.select(F.col("query_id").alias("block"), (F.col("query_id") * threads + F.col("e") % threads).alias("thread"), seq.alias("seq"), at.alias("index"))


def search(
    index: DataFrame, centroids: DataFrame, queries: DataFrame, nprobe: int = 10, k: int = 1, exclude_self: bool = False, outer: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, pos, dist): the k nearest members of the nprobe nearest clusters.

    Ties go to the lowest vec_id. queries needs query_id and embedding, and vec_id to exclude self. Clusters that the
    index lacks, negative ones too, are passed over.
    With outer, a query without candidates has one row -1, -1, infinity.
    """
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    parts = []
    for q in blocks(queries, "query_id", "embedding"):
        ids, mat = matrix(q, "query_id", "embedding")
        if not len(ids):
            continue
        own = None
        if exclude_self:
            own = np.array([r.vec_id for r in q.select("query_id", "vec_id").orderBy("query_id").collect()], dtype=np.int64)
        place = {int(x): i for i, x in enumerate(ids)}
        probes: dict[int, list[int]] = {}
        for r in top_centroids(q, centroids, nprobe).select("query_id", "cluster_id").collect():  # nprobe rows a query
            probes.setdefault(r.cluster_id, []).append(place[r.query_id])
        asked = {c: np.array(x) for c, x in probes.items()}
        # vectors stay where they are; each partition sends k rows a query
        parts.append(partial_topk(index.filter(F.col("cluster_id").isin(sorted(asked))), ids, mat, k, own, asked, ("pos",)))
    schema = "query_id bigint, vec_id bigint, dist double, pos bigint"
    d = reduce(DataFrame.unionByName, parts) if parts else index.sparkSession.createDataFrame([], schema)
    best = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "pos", "dist")
    if not outer:
        return best
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce("vec_id", F.lit(-1)).alias("vec_id"),
        F.coalesce("pos", F.lit(-1)).alias("pos"),
        F.coalesce("dist", F.lit(float("inf"))).alias("dist"),
    )
