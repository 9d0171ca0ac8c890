"""Seeded synthetic vectors, graphs and access traces. A row depends on its id and the seed alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import MASK32, digits, mix32, mul32, share, uniform01
from .positions import exclusive_sum

# Fixed values of the element hash and of the trace hash.
LCG_MULTIPLIER = 1664525
LCG_INCREMENT = 1013904223
TRACE_MULTIPLIER = 2654435761
PAGE = 1024


def hash_elements(spark: SparkSession, total: int, seed: int = 42) -> DataFrame:
    """(t, value FLOAT in [0, 1)): element t of the hashed vector data."""
    t = F.col("t").bitwiseAND(F.lit(MASK32))
    h = (mul32(t, LCG_MULTIPLIER) + F.lit(LCG_INCREMENT + seed)).bitwiseAND(F.lit(MASK32))
    value = (mix32(h).bitwiseAND(F.lit(0xFFFFFF)).cast("double") / F.lit(16777216.0)).cast("float")
    return spark.range(total).select(F.col("id").alias("t")).select("t", value.alias("value"))


def hash_vectors(spark: SparkSession, count: int, dim: int = 128, seed: int = 42) -> DataFrame:
    """(vec_id, embedding) of dim hashed elements each, without a shuffle."""
    base = F.col("id") * F.lit(dim)

    def element(i):
        t = (base + i.cast("bigint")).bitwiseAND(F.lit(MASK32))
        h = (mul32(t, LCG_MULTIPLIER) + F.lit(LCG_INCREMENT + seed)).bitwiseAND(F.lit(MASK32))
        return (mix32(h).bitwiseAND(F.lit(0xFFFFFF)).cast("double") / F.lit(16777216.0)).cast("float")

    return spark.range(count).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), element).alias("embedding"))


def uniform_edges(spark: SparkSession, scale: int, target_degree: int, seed: int = 42) -> DataFrame:
    """n * target_degree / 2 drawn pairs of 2^scale nodes, self loops dropped; symmetrize() makes the graph."""
    n = 1 << scale
    draw = lambda salt: F.floor(uniform01(F.col("id"), seed, salt) * n).cast("bigint")
    return spark.range(n * target_degree // 2).select(draw(1).alias("src"), draw(2).alias("dst")).filter("src <> dst")


def rmat_edges(
    spark: SparkSession, scale: int, edge_factor: int = 16, a: float = 0.57, b: float = 0.19, c: float = 0.19, d: float = 0.05, seed: int = 42
) -> DataFrame:
    """n * edge_factor recursive-matrix draws; each level of an edge takes one quadrant by 16 bits of its hash. d is the rest."""
    if min(a, b, c, d) < 0 or abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("a, b, c and d must be shares of 1")
    src = dst = F.lit(0).cast("bigint")
    for level in range(scale):
        r = share(digits(F.col("id"), seed, level // 8), 4 * (level % 8) + 1, 4)
        down, right = r >= a + b, ((r >= a) & (r < a + b)) | (r >= a + b + c)
        src = src * 2 + down.cast("bigint")
        dst = dst * 2 + right.cast("bigint")
    return spark.range((1 << scale) * edge_factor).select(src.alias("src"), dst.alias("dst")).filter("src <> dst")


def uniform_trace(spark: SparkSession, count: int, elements: int, seed: int = 42) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("seq"), F.floor(uniform01(F.col("id"), seed, 3) * elements).cast("bigint").alias("index"))


def zipf_cdf(spark: SparkSession, pages: int, skew: float = 1.0) -> DataFrame:
    """(page, lo, hi): the share of accesses up to each page when page p weighs 1/(p+1)^skew.

    Weights are summed inside blocks of pages; one window runs over the block sums.
    """
    p = spark.range(pages).select(F.col("id").alias("page"), F.pow(F.col("id") + F.lit(1.0), F.lit(-float(skew))).alias("w"))
    b = p.withColumn("b", F.floor(F.col("page") / 4096))
    o = b.groupBy("b").agg(F.sum("w").alias("t"))
    o = o.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("o"))
    total = p.agg(F.sum("w").alias("total"))
    inner = Window.partitionBy("b").orderBy("page")
    hi = b.join(o, "b").crossJoin(F.broadcast(total)).withColumn("hi", (F.col("o") + F.sum("w").over(inner)) / F.col("total"))
    return hi.select("page", (F.col("hi") - F.col("w") / F.col("total")).alias("lo"), "hi")


def zipf_trace(spark: SparkSession, count: int, pages: int, skew: float = 1.0, seed: int = 42) -> DataFrame:
    """(seq, index): a page by the first cdf value not below a draw, then a hashed offset in it.

    Draws and pages meet on cells of the unit interval, so this is an equi-join and not a nested loop.
    """
    cells = max(1, min(pages, 1 << 16))
    cdf = zipf_cdf(spark, pages, skew)
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("bigint")
    ranges = cdf.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.col("lo"), F.lit(0.0))), cell(F.col("hi")))))
    last = F.col("page") == pages - 1
    draws = spark.range(count).select(F.col("id").alias("seq"), uniform01(F.col("id"), seed, 4).alias("r")).withColumn("cell", cell(F.col("r")))
    hit = draws.join(ranges, "cell").filter(((F.col("r") <= F.col("hi")) | last) & ((F.col("r") > F.col("lo")) | (F.col("page") == 0)))
    best = hit.groupBy("seq").agg(F.min("page").alias("page"))  # rounding may let two neighbours match
    return best.select("seq", (F.col("page") * PAGE + F.floor(uniform01(F.col("seq"), seed, 5) * PAGE)).cast("bigint").alias("index"))


def warp_shared_trace(spark: SparkSession, count: int, unique: int, pages: int, page: int = PAGE) -> DataFrame:
    """(seq, warp, lane, page, index): the lanes of a warp share `unique` hashed pages."""
    seq = F.col("id")
    warp, lane = F.floor(seq / 32), seq % 32
    key = (warp * unique + lane % unique).bitwiseAND(F.lit(MASK32))
    p = mul32(key, TRACE_MULTIPLIER) % pages
    return spark.range(count).select(seq.alias("seq"), warp.alias("warp"), lane.alias("lane"), p.alias("page"), (p * page + lane % page).alias("index"))


def identity_backing(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("index"), F.col("id").alias("value"))


def fake_degrees(spark: SparkSession, nodes: int = 4096, low: int = 16, spread: int = 32, seed: int = 123) -> DataFrame:
    """(node, degree) with hashed degrees low .. low + spread - 1."""
    return spark.range(nodes).select(F.col("id").alias("node"), (F.floor(uniform01(F.col("id"), seed, 6) * spread) + low).cast("bigint").alias("degree"))


def fake_offsets(spark: SparkSession, nodes: int = 4096, elements: int = 1 << 20, seed: int = 123) -> DataFrame:
    """(node, offset, degree): the running sum of fake degrees, cut off at the end of the array."""
    d = exclusive_sum(fake_degrees(spark, nodes, seed=seed), "node", "degree", "begin")
    start = F.least(F.col("begin"), F.lit(elements))
    return d.select("node", start.alias("offset"), (F.least(F.col("begin") + F.col("degree"), F.lit(elements)) - start).alias("degree"))


def sequential_trace(spark: SparkSession, threads: int, per_thread: int = 64) -> DataFrame:
    """(seq, block, thread, index): each thread reads its own stretch of the array; all threads take a step before the next."""
    t = F.col("id") % threads
    return spark.range(threads * per_thread).select(
        F.col("id").alias("seq"), F.floor(t / 1024).alias("block"), t.alias("thread"), (t * per_thread + F.floor(F.col("id") / threads)).alias("index")
    )


def strided_trace(spark: SparkSession, threads: int, pages: int, per_thread: int = 4, offset: int = 7, page: int = PAGE) -> DataFrame:
    """(seq, thread, index): thread i touches pages (i*k + j) mod pages at a fixed offset."""
    seq = F.col("id")
    return spark.range(threads * per_thread).select(seq.alias("seq"), F.floor(seq / per_thread).alias("thread"), ((seq % pages) * page + offset).alias("index"))
