"""Sharding as vector bin packing over bytes, tokens and rows.

Items are vectors of (bytes, tokens, rows) in shares of the whole. In descending order of their
largest share, each goes to the shard where the dot product with the residual capacity is highest.

An item is a group of equal texts if the group is heavy (over 1/HEAVY of a total); all other groups are
gathered by hash into a fixed number of cells. Only a group of more than a whole shard is cut, into a multiple
of the shard count, so that its pieces spread evenly. At most 3 * HEAVY groups are heavy and at most 3 * shards
of them are cut, so the item table, which the driver packs and broadcasts, has a bound whatever the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

SHARDS = 40
CELLS = 1 << 13
#: A group of equal texts with more than 1/HEAVY of the bytes, tokens or rows is an item of its own.
HEAVY = 1 << 11
ROW_BYTES = 16
#: Rows of one item that are numbered in one piece; larger items are numbered in blocks.
SLOT_ROWS = 1 << 16
DIMS = ("bytes", "tokens", "rows")
#: Bytes weigh double, since the law that is promised is theirs.
WEIGHTS = (2.0, 1.0, 1.0)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, g) for each row; g is a hash of the text, so equal texts share it.

    tokens counts words between white space. A NULL text has no bytes, no tokens and no checksum.
    """
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.when(t.isNull(), 0).otherwise(words).cast("bigint").alias("tokens"),
        F.xxhash64(t).alias("g"),
    )


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items is (n, dims), in the order that breaks ties."""
    total = items.sum(0, dtype=np.float64)
    x = items / np.where(total > 0, total, 1)
    x *= np.array(WEIGHTS[: items.shape[1]])
    left = np.tile(x.sum(0) / shards, (shards, 1))
    out = np.empty(len(items), dtype=np.int64)
    for i in np.argsort(-x.max(1), kind="stable"):
        s = int(np.argmax(left @ x[i]))  # the lowest shard on ties
        out[i] = s
        left[s] -= x[i]
    return _settle(x, out, left)


def _settle(x: np.ndarray, out: np.ndarray, left: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Moves or swaps items while that lowers the sum of squared residuals.

    Moving d from shard f to shard t changes the sum by 2 (d . (left[f] - left[t]) + d . d), again dot products
    with residuals; a swap moves the difference of two items.
    """
    norm = (x * x).sum(1)
    for _ in range(rounds):
        worst = np.argsort(-(left * left).sum(1))
        for a in worst[:4]:
            mine = np.flatnonzero(out == a)
            give = x[mine] @ (left[a] - left).T + norm[mine, None]
            take = ((left[out] - left[a]) * x).sum(1) + norm
            give[:, a], take[mine] = 0, 0
            g, t = (int(give.argmin()) if give.size else -1), int(take.argmin())
            low = min(give.flat[g] if g >= 0 else 0, take[t])
            if low < -1e-12:
                i, to = (t, int(a)) if take[t] == low else (int(mine[g // len(left)]), g % len(left))
                left[out[i]] += x[i]
                left[to] -= x[i]
                out[i] = to
                break
            b = int(((left - left[a]) ** 2).sum(1).argmax())
            theirs = np.flatnonzero(out == b)
            if 0 < len(mine) * len(theirs) <= 1 << 18:
                d = x[mine][:, None] - x[theirs][None]
                change = d @ (left[a] - left[b]) + (d * d).sum(2)
                i, j = divmod(int(change.argmin()), len(theirs))
                if change[i, j] < -1e-12:
                    left[a] += d[i, j]
                    left[b] -= d[i, j]
                    out[mine[i]], out[theirs[j]] = b, a
                    break
        else:
            break
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text).

    law is `bytes`. Equal texts share a shard unless their group was cut. Rows keep one row each, repeated ones too;
    slot counts from 0 in each shard without gaps, by item, block and then doc_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    m = cut(measured(docs))
    total = m.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    schema = "item bigint, shard int, first bigint, blocks bigint"
    if not total[2]:
        placed = spark.createDataFrame([], schema)
        heavy = spark.createDataFrame([], "g bigint, pieces bigint, at bigint")
    else:
        groups = m.groupBy("g").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
        share = F.greatest(*(F.col(c) / F.lit(float(max(1, total[i]))) for i, c in enumerate("btr")))
        one = F.col("r") == 1  # a single row is not cut
        rows = groups.withColumn("s", share).filter(F.col("s") * HEAVY > 1).select("g", F.when(one | (F.col("s") * shards <= 1), 1).otherwise(F.ceil(F.col("s") * 2) * shards).cast("bigint").alias("p")).orderBy("g").collect()
        ends = np.cumsum([r.p for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        heavy = spark.createDataFrame([(r.g, r.p, CELLS + int(e) - r.p) for r, e in zip(rows, ends, strict=True)], "g bigint, pieces bigint, at bigint")
    light = F.pmod("g", F.lit(CELLS))
    piece = F.col("at") + F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces"))
    m = m.join(F.broadcast(heavy), "g", "left").withColumn("item", F.coalesce(piece, light)).drop("g", "pieces", "at")
    if total[2]:
        sums = m.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("item").collect()
        to = pack(np.array([[r[d] for d in DIMS] for r in sums], dtype=np.float64), shards)
        first, at = np.zeros(len(sums), dtype=np.int64), np.zeros(shards, dtype=np.int64)
        for i, r in enumerate(sums):
            first[i] = at[to[i]]
            at[to[i]] += r.rows
        placed = spark.createDataFrame([(r.item, int(s), int(f), -(-r.rows // SLOT_ROWS)) for r, s, f in zip(sums, to, first, strict=True)], schema)
    m = m.join(F.broadcast(placed), "item").withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("blocks")))
    upto = Window.partitionBy("item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = m.filter("blocks > 1").groupBy("item", "block").agg(F.count("*").alias("n"))
    before = counts.select("item", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    w = Window.partitionBy("item", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        m.join(before, ["item", "block"], "left")
        .withColumn("slot", F.col("first") + F.coalesce("before", F.lit(0)) + F.row_number().over(w) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
