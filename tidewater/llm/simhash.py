"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four
bits, one segment differs in at most one bit (three segments with two bits each would make six).
Each segment is indexed once for each of its bits with that bit left out: segments that differ
in at most one bit share such a variant. An equality join on the variants finds the candidates,
and the whole fingerprints decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, documents, grouped, map_rows

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Buckets up to this size compare all their members at once; larger ones go by elimination.
SMALL_BUCKET = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp), h a hash of the text that tells rows of one doc_id apart. Equal texts of a batch are worked once."""

    def run(c: dict[str, list]) -> dict[str, list]:
        own: dict[str | None, int] = {}
        for t in c["text"]:
            if t not in own:
                own[t] = fingerprint(t, shingle)
        return {"doc_id": c["doc_id"], "h": c["h"], "fp": [own[t] for t in c["text"]]}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_rows(rows, "doc_id bigint, h bigint, fp bigint", run)


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments for fingerprints that differ in at most `bits` bits."""
    n = bits // 2 + 1
    if n < 2:
        raise ValueError("bits must be 2 or more: one segment would be the whole fingerprint")
    base, more = divmod(64, n)
    widths = [base + (i < more) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def variants(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(key, fp): for each bit of each segment, the segment without that bit, tagged by the bit's number."""
    keys = []
    for low, width in segments(bits):
        seg = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        for k in range(width):
            under = seg.bitwiseAND(F.lit((1 << k) - 1))
            above = F.shiftleft(F.shiftright(seg, k + 1), k)
            keys.append(above.bitwiseOR(under) + F.lit((low + k) << 56))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _links(fps: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked inside each bucket: all pairs of small buckets, a spanning forest of large ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    own = np.repeat(size, size)
    rows = np.flatnonzero((own > 1) & (own <= SMALL_BUCKET))
    f, k = fps[rows], keys[rows]
    for lag in range(1, min(SMALL_BUCKET, int(size[size <= SMALL_BUCKET].max(initial=1)))):
        x, y = f[:-lag], f[lag:]
        if not len(x):
            break
        hit = (k[:-lag] == k[lag:]) & (np.bitwise_count(x ^ y) <= bits)
        left.append(x[hit])
        right.append(y[hit])
    for s, n in zip(starts[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
        rest = fps[s : s + n]
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                p = queue.pop()
                near = np.bitwise_count(rest ^ p) <= bits
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), p))
                    right.append(found)
                    queue.extend(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): distinct fingerprints that differ in at most `bits` bits, enough of them to join every group.

    Buckets are streamed from sorted partitions. In a dense bucket each found member is removed from the
    candidates, so a group of n copies costs about n comparisons and n links, not n^2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key"]):
            a, b = _links(np.asarray(t.column("fp")).view(np.uint64), np.asarray(t.column("key")), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    # spread before every row becomes 64
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = variants(fps.select("fp").repartition(parts, "fp"), bits)
    return v.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, h, fingerprint, component_id, fp_component) for each row of docs (doc_id, text).

    A NULL or empty text has fingerprint zero, linked like any other. Repeated rows keep one row each.
    component_id is NULL only if every doc_id of the component is NULL. An empty table gives no rows.
    """
    f = cut(fingerprints(docs, shingle))
    distinct = cut(f.groupBy("fp").agg(F.min("doc_id").alias("low")))
    c = components(links(distinct, bits)).select(F.col("node").alias("fp"), "component")
    named = distinct.join(c, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    # summed up in a stage of its own, so that the join may split a component that holds much
    ids = cut(named.groupBy("component").agg(F.min("low").alias("component_id")))
    named = named.join(ids, "component").select("fp", "component", "component_id")
    return f.join(named, "fp").select(
        "doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("component").alias("fp_component")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group: of its smallest doc_id (NULL last), then the smallest text hash; one if that repeats.

    The decision is made on ids and hashes; texts are moved once, to the join.
    """
    n = near_duplicates(docs.select("doc_id", "text"), shingle, bits)
    last = F.lit((1 << 63) - 1)
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("o"), F.col("doc_id").isNull().alias("z"), "h")).alias("s")
    stay = n.groupBy("fp_component").agg(first).select("s.o", "s.z", "s.h")
    # rows travel as one struct, so that further columns may have any name; the window needs no shuffle of its own
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), last).alias("o"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("h"))
    w = Window.partitionBy("o", "z", "h").orderBy("o")
    return rows.join(stay, ["o", "z", "h"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
