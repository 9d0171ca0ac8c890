"""Edge lists, CSR views, degree statistics and breadth-first search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .positions import exclusive_sum

DST_BLOCK = 1 << 20


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, without self loops and duplicates."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); nodes without edges get a 0 only if a node table is given."""
    d = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    if nodes is None:
        return d
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(deg: DataFrame) -> DataFrame:
    """One row n, total, avg, min, q1, median, q3, max; quartiles by nearest rank trunc(n*q).

    Ranks come from the degree histogram, so the one ordered window is over distinct degrees.
    """
    h = deg.groupBy("degree").agg(F.count("*").alias("c"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("degree", "c", F.sum("c").over(w).alias("upto"))
    t = h.agg(F.sum("c").alias("n"), F.sum(F.col("degree") * F.col("c")).alias("total"))
    rank = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("degree")))
    return h.crossJoin(F.broadcast(t)).agg(
        F.max("n").alias("n"),
        F.max("total").alias("total"),
        (F.max("total") / F.max("n")).alias("avg"),
        F.min("degree").alias("min"),
        rank(0.25).alias("q1"),
        rank(0.5).alias("median"),
        rank(0.75).alias("q3"),
        F.max("degree").alias("max"),
    )


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, offset, degree), the exclusive prefix sum of degrees in node order, and an end row with node NULL."""
    d = degrees(edges, nodes)
    end = d.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("offset"))
    return exclusive_sum(d, "node", "degree", "offset").select("node", "offset", "degree").unionByName(
        end.select(F.lit(None).cast("bigint").alias("node"), "offset", F.lit(0).cast("bigint").alias("degree"))
    )


def csr_edges(edges: DataFrame) -> DataFrame:
    """(pos, src, dst) in the order (src, dst). A hub's targets are ranked in blocks, not in one task."""
    d = degrees(edges)
    off = exclusive_sum(d, "node", "degree", "offset").select(F.col("node").alias("src"), "offset")
    b = edges.select("src", "dst", F.floor(F.col("dst") / DST_BLOCK).alias("b"))
    w = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = b.groupBy("src", "b").agg(F.count("*").alias("c")).withColumn("bo", F.coalesce(F.sum("c").over(w), F.lit(0)))
    placed = b.join(blocks.join(off, "src").select("src", "b", (F.col("bo") + F.col("offset")).alias("o")), ["src", "b"])
    inner = Window.partitionBy("src", "b").orderBy("dst")
    return placed.select((F.col("o") + F.row_number().over(inner) - 1).alias("pos"), "src", "dst")


def pick_source(deg: DataFrame) -> DataFrame:
    """The node of highest degree, lowest id first."""
    return deg.orderBy(F.desc("degree"), F.asc("node")).limit(1)


def graph_metadata(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    s = pick_source(d).select(F.col("node").alias("source"), F.col("degree").alias("max_deg"))
    n = d.agg(F.count("*").alias("num_nodes"), F.sum("degree").alias("num_edges"))
    return n.crossJoin(s).select("num_nodes", "num_edges", "source", "max_deg")


#: Frontiers of up to so many counted nodes are sent to the edges; larger ones are dealt out like them.
SMALL_FRONTIER = 100_000


def bfs(edges: DataFrame, source: int, max_levels: int | None = None, symmetric: bool = True, width: int | None = None) -> DataFrame:
    """(node, dist) of the nodes reached from the source, level by level.

    Edges stay partitioned by src over all levels. On a symmetric graph a neighbour of
    level L lies in L-1, L or L+1, so only two frontiers are subtracted, not all of the
    visited set. Each frontier is checkpointed; the answer is the union of the frontiers. width is the
    number of partitions of the edges; the result does not depend on it.
    """
    spark = edges.sparkSession
    held = edges.select("src", "dst")
    held = (held.repartition(width, "src") if width else held.repartition("src")).persist()
    try:
        now = cut(spark.createDataFrame([(int(source), 0)], "node bigint, dist int"))
        levels, size = [now], 1
        while max_levels is None or len(levels) <= max_levels:
            seen = reduce(DataFrame.unionByName, levels[-2:] if symmetric else levels).select("node")
            front = F.broadcast(now) if size <= SMALL_FRONTIER else now
            step = held.join(front, held.src == front.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
            now = cut(step.withColumn("dist", F.lit(len(levels))))
            size = now.count()
            if not size:
                break
            levels.append(now)
    finally:
        held.unpersist()
    return reduce(DataFrame.unionByName, levels)


def bfs_trace(edges: DataFrame, nodes: DataFrame, dist: DataFrame, width: int = 32) -> DataFrame:
    """(launch, block, thread, seq, index): the reads of the edge array by a search, each level a launch.

    The nodes of a level follow in the order of their ids; `width` threads share a node and take its edges in
    turn. A block has 1024 threads.
    """
    level = dist.select(F.col("dist").alias("launch"), "node", F.floor(F.col("node") / DST_BLOCK).alias("b"))
    upto = Window.partitionBy("launch").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = level.groupBy("launch", "b").agg(F.count("*").alias("c")).select("launch", "b", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("o"))
    inner = Window.partitionBy("launch", "b").orderBy("node")
    placed = level.join(blocks, ["launch", "b"]).select("launch", "node", (F.col("o") + F.row_number().over(inner) - 1).alias("turn"))
    off = csr_offsets(edges, nodes).filter("degree > 0")
    each = placed.join(off, "node").select("launch", "turn", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("degree") - 1)).alias("j"))
    thread = F.col("turn") * width + F.col("j") % width
    return each.select(
        "launch", F.floor(thread / 1024).alias("block"), thread.alias("thread"), F.struct("launch", "turn", "j").alias("seq"), (F.col("offset") + F.col("j")).alias("index")
    )


def frontier_sizes(dist: DataFrame) -> DataFrame:
    return dist.groupBy(F.col("dist").alias("level")).agg(F.count("*").alias("new_nodes"))


def bfs_summary(dist: DataFrame, deg: DataFrame) -> DataFrame:
    """One row max_level, nodes_reached, edges_accessed; every reached node is expanded once."""
    return dist.join(deg, "node", "left").agg(
        F.max("dist").alias("max_level"),
        F.count("*").alias("nodes_reached"),
        F.coalesce(F.sum("degree"), F.lit(0)).cast("bigint").alias("edges_accessed"),
    )


def expand(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Distinct neighbours of a frontier."""
    return edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()


def unreached(nodes: DataFrame, dist: DataFrame) -> DataFrame:
    return nodes.join(dist, "node", "left_anti")


def segment_sum(offsets: DataFrame, backing: DataFrame) -> DataFrame:
    """(node, total): sum of backing values in [offset, offset+degree); an empty segment is 0."""
    o = offsets.filter("node IS NOT NULL")
    slots = o.filter("degree > 0").select("node", F.explode(F.expr("sequence(offset, offset + degree - 1)")).alias("index"))
    s = slots.join(backing, "index").groupBy("node").agg(F.sum(F.col("value").cast("bigint")).alias("total"))
    return o.select("node").join(s, "node", "left").select("node", F.coalesce("total", F.lit(0)).alias("total"))
