"""Prefix sums and global positions without a window over all rows in one task.

Keys are cut into blocks. Each block is summed or ranked by itself; only the block
totals meet in one window, and there are as many of those as blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def exclusive_sum(df: DataFrame, key: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """df with out = sum of value over the rows with a smaller key. Keys are distinct integers."""
    b = df.withColumn("_b", F.floor(F.col(key) / block))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("_b").agg(F.sum(value).alias("_t")).select("_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    return b.join(totals, "_b").withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("_o")).drop("_b", "_o")


def global_position(df: DataFrame, key: str, out: str, block: int = BLOCK, ties: list[Column] | None = None) -> DataFrame:
    """df with out = its 0-based position in the order of an integer key (then ties)."""
    b = df.withColumn("_b", F.floor(F.col(key) / block))
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("_b").agg(F.count("*").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_b").orderBy(F.col(key), *(ties or []))
    return b.join(totals, "_b").withColumn(out, F.row_number().over(inner) - 1 + F.col("_o")).drop("_b", "_o")
