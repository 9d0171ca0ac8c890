"""Shared pieces of the operators: text mapping, group streaming, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut, ensure_checkpoint_dir

__all__ = ["components", "cut", "documents", "ensure_checkpoint_dir", "fresh", "grouped", "map_rows", "map_texts", "slices", "table", "written"]


#: Arrow batches are turned into Python objects so many bytes at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text alone, so that the scan reads two columns."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, so many at a time as hold about `size` bytes: Python's objects are several times larger."""
    if batch.num_rows:
        n = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def map_rows(df: DataFrame, schema: str, f: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with a function from lists of a slice's columns to lists of the new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, arrow[k]) for k, v in out.items()})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields}
    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, f: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow to rows of the same columns, whatever their names; f also gets the place of the column text."""
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]  # mapInArrow looks its columns up by name, where a dot would mean a field
    kind = StructType([StructField(n, x.dataType, x.nullable) for n, x in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(lambda batches: f(batches, at), kind).toDF(*docs.columns)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from batches sorted by the keys.

    Each yielded table holds complete groups only; what a batch cuts off waits for the next, and is copied once.
    """
    held: list[pa.RecordBatch] = []
    last: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [np.asarray(b.column(b.schema.get_field_index(k))) for k in keys]
        differs = np.zeros(b.num_rows, dtype=bool)
        differs[0] = last is not None and any(k[0] != x for k, x in zip(ks, last, strict=True))
        for k in ks:
            differs[1:] |= k[1:] != k[:-1]
        last = [k[-1] for k in ks]
        at = np.flatnonzero(differs)
        if len(at):
            start = int(at[-1])
            yield pa.Table.from_batches([*held, b.slice(0, start)] if start else held).combine_chunks()
            held = [b.slice(start)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Large-star and small-star rounds; both keep connectivity and move each node to a smaller
    neighbour, until every tree is a star. Minima are combined before the shuffle and joined back,
    so a hub is split by the skew join. Each round is checkpointed; nothing is collected but two sums.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut(e)
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = cut(small.select("s.u", "s.v").filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
