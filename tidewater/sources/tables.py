"""Test-data tables and the graph, vector and trace views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def purchase_edges(spark: SparkSession, sf_dir: str, min_quantity: float | None = None) -> DataFrame:
    """Bipartite customer-part edges, one direction: u = 2*custkey, v = 2*partkey+1. All purchases unless min_quantity is given."""
    li = table(spark, sf_dir, "lineitem")
    if min_quantity is not None:
        li = li.filter(F.col("l_quantity") >= min_quantity)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")
    )


def purchase_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("node"))
    return c.unionByName(p).distinct()


def event_trace(spark: SparkSession, sf_dir: str, block_threads: int | None = None) -> DataFrame:
    """Access trace: seq = event_id, thread = user_id, warp of 32 threads; one block, or one for so many threads."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        (F.expr(f"user_id div {block_threads}") if block_threads else F.lit(0).cast("bigint")).alias("block"),
        F.expr("user_id div 32").alias("warp"),
        F.col("user_id").alias("thread"),
        ((F.col("user_id") * 7919 + F.col("event_id") * 37) % 1048576).alias("index"),
    )
