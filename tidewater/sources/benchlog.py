"""Benchmark logs of '|'-separated rows, as typed rows and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the log format: column names and the marks that begin a row.
ANN_COLUMNS = ["Method", "WPQ", "Threads_Per_Q", "Blocks", "Time_ms", "VRAM_Hits", "DRAM_Misses", "Status"]
BFS_COLUMNS = ["Method", "TPN", "Time_ms", "Edges_Acc", "T1_Hits", "T2_T3_Hits", "DRAM_Misses", "Status"]
ROW_MARKS = ("Target_T", "BaM")


def parse_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose line begins with Target_T or BaM, cut on '|' and trimmed of blanks and tabs; N/A becomes NULL."""
    cell = F.split("value", r"\|")

    def field(i: int, name: str) -> Column:
        x = F.regexp_replace(F.get(cell, i), r"^[ \t]+|[ \t]+$", "")
        if name in ("Method", "Status"):
            return x.alias(name)
        return x.try_cast(
            "double" if name == "Time_ms" else "bigint"
        ).alias(name)

    return lines.filter(F.col("value").rlike(f"^({'|'.join(ROW_MARKS)})")).select(*(field(i, c) for i, c in enumerate(columns)))


def read_bench_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in ("ann", "bfs"):
        raise ValueError("kind must be 'ann' or 'bfs'")
    return parse_lines(spark.read.text(path), ANN_COLUMNS if kind == "ann" else BFS_COLUMNS)


def write_bench_csv(parsed: DataFrame, path: str) -> None:
    parsed.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
