"""Embedding near-duplicates with randomised-rotation binary codes.

Equal vectors are one class with a count. A class's unit vector o is rotated by a random orthogonal matrix P; the code
is the signs x of the rotated vector, stored with the correction factor f = <x, Po> / sqrt(D), and with Po itself in
steps of a byte, whose signs the code is. For another vector q, <x, Pq> / (sqrt(D) f) is an unbiased estimate of
<o, q> whose error is about sqrt(1 - f^2) / (f sqrt(D - 1)), and half a step in each element of Pq adds at most
step * sqrt(D) / (2 f); a pair is recomputed exactly, in double precision, unless the estimate plus CONFIDENCE errors
and that addition is below the threshold.

Pairs are looked for in tables: each table takes K sign bits of directions of its own as the key of a bucket. K grows
with the logarithm of the classes and the number of tables follows, so that a pair at the threshold shares a bucket
with probability RECALL and closer pairs more often. Large buckets are cut into blocks, and each pair of blocks is a
task of its own: all pairs in a bucket are compared by their codes, but none is sent anywhere. Codes alone are sent to
the tables; the vectors of those rows that have a pair to recompute follow them, once for each bucket. What leaves a
bucket is a count for each class and a spanning forest of the links.

Codes are bytes and directions integers, so keys and estimates are exact sums, the same wherever they are worked out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, grouped, table, written

THRESHOLD = 0.95
RECALL = 0.995
CONFIDENCE = 4.0
#: Rows of a bucket compared in one piece; larger buckets are cut into blocks of about this.
BLOCK = 2048
SEED = 20240613
#: Large buckets are named to every task if their counted number stays below this; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 200_000
#: Steps of a direction's elements, which are whole numbers.
GRAIN = 1024


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables) for this many rows: about 64 rows a bucket if they were spread evenly."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / 64 + 1)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - together)) if together < 1 else 1


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows have one): NULL, zero, incomplete, non-finite or of another length have none."""
    rows = column.to_pylist()
    x, ok = np.zeros((len(rows), dim)), np.zeros(len(rows), dtype=bool)
    for i, r in enumerate(rows):
        if r is not None and len(r) == dim and None not in r:
            x[i], ok[i] = r, True
    with np.errstate(all="ignore"):
        most = np.abs(x).max(1, initial=0)
        ok &= np.isfinite(most) & (most > 0)
        x[ok] /= most[ok, None]  # so that no square is too large or too small
        x[ok] /= np.sqrt((x[ok] * x[ok]).sum(1))[:, None]
    return x, ok


def codes(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, factor, step) of unit vectors: the rotated vector is step * (byte + 1/2), give or take half a step."""
    y = x @ p
    step = np.abs(y).max(1) / 127
    q = np.clip(np.floor(y / step[:, None]), -128, 127).astype(np.int8)
    return q, np.where(q >= 0, y, -y).sum(1) / math.sqrt(x.shape[1]), step


def keys(q: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys: signs along random directions; a table's number is in its key."""
    g = np.rint(np.random.default_rng(SEED + 1).standard_normal((q.shape[1], tables * bits)) * GRAIN)
    s = ((2.0 * q + 1) @ g > 0).reshape(len(q), tables, bits).astype(np.int64)
    return (s << np.arange(bits)).sum(2) + (np.arange(tables, dtype=np.int64) << 40)


def candidates(code: tuple, ks: np.ndarray, t: int, a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the pairs between two slices that the bound leaves and that share no earlier table."""
    q, f, step = code
    dim = q.shape[1]
    x, y = np.where(q[a] >= 0, 1.0, -1.0), 2.0 * q[b] + 1
    est = (x @ y.T) * (step[b] / 2) / (math.sqrt(dim) * f[a, None])
    err = CONFIDENCE * np.sqrt(np.maximum(0, 1 - f[a] ** 2)) / (f[a] * math.sqrt(max(1, dim - 1)))
    i, j = np.nonzero(est + err[:, None] + step[b] * math.sqrt(dim) / (2 * f[a, None]) >= threshold)
    i, j = i + a.start, j + b.start
    if a == b:
        i, j = i[i < j], j[i < j]
    if t:
        late = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 1 << 16):
            u = slice(k, k + (1 << 16))
            late[u] = (ks[i[u], :t] == ks[j[u], :t]).any(1)
        i, j = i[~late], j[~late]
    return i, j


def exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    hit = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 16):
        u = slice(k, k + (1 << 16))
        hit[u] = np.einsum("ij,ij->i", x[i[u]], x[j[u]]) >= threshold
    return i[hit], j[hit]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root) that join what the pairs join: labels fall to the least of their neighbours' until none moves."""
    low = np.arange(n)
    while len(i):
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == was).all():
            break
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def _pairs(g: pa.Table, dim: int, bits: int, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs of whole groups of one key and pair of blocks."""
    key, pair, own, f, step = (np.asarray(g.column(c)) for c in ("key", "pair", "own", "f", "step"))
    q = np.frombuffer(b"".join(g.column("q").to_pylist()), dtype=np.int8).reshape(-1, dim)
    ks = keys(q, bits, tables)
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    ii, jj = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for s, e in zip(at.tolist(), np.r_[at[1:], len(key)].tolist(), strict=True):
        if e - s < 2:
            continue
        lo, hi = divmod(int(pair[s]), 1 << 20)
        m = e if lo == hi else s + int(np.searchsorted(own[s:e], hi))
        i, j = candidates((q, f, step), ks, int(key[s] >> 40), slice(s, m), slice(s, e) if lo == hi else slice(m, e), threshold)
        ii.append(i)
        jj.append(j)
    return np.concatenate(ii), np.concatenate(jj)


def links(classes: DataFrame, rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b, n) of classes (c, n, embedding): n > 0 and b NULL, the members of the classes that a links with in one
    bucket; n = 0, an edge of a bucket's spanning forest. Rows (c, NULL, 0) name the classes that have a unit vector."""
    bits, tables = plan(rows, threshold, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rotation(dim, SEED)
        for b in batches:
            x, ok = unit(b.column("embedding"), dim)
            q, f, step = codes(x[ok], p)
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [kept.column("c"), kept.column("n"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(f), pa.array(step), kept.column("embedding")],
                names=["c", "n", "q", "f", "step", "embedding"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = keys(np.frombuffer(b"".join(b.column("q").to_pylist()), dtype=np.int8).reshape(-1, dim), bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(k[:, t]), *b.columns], names=["key", *b.schema.names])

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys(np.frombuffer(b"".join(b.column("q").to_pylist()), dtype=np.int8).reshape(-1, dim), bits, tables).ravel())], names=["key"])

    stored = written(classes.mapInArrow(code, "c bigint, n bigint, q binary, f double, step double, embedding array<double>"))
    big = stored.select("q").mapInArrow(only_keys, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    big = cut(big.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    d = stored.select("c", "q", "f", "step").mapInArrow(place, "key bigint, c bigint, q binary, f double, step double")
    d = d.join(F.broadcast(big) if big.count() <= BROADCAST_ROWS else big, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a row of block o goes to the pairs (o, c) and (c, o), named by the smaller block first
    d = d.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("pair", F.least("own", "other").cast("bigint") * F.lit(1 << 20) + F.greatest("own", "other")).select("key", "pair", "own", "c", "q", "f", "step")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["key", "pair"]):
            i, j = _pairs(g, dim, bits, tables, threshold)
            yield from g.take(pa.array(np.unique(np.r_[i, j]))).select(["key", "pair", "own", "c"]).combine_chunks().to_batches()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["key", "pair"]):
            i, j = _pairs(g, dim, bits, tables, threshold)
            flat = g.column("embedding").combine_chunks()
            x, _ = unit(flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat, dim)
            i, j = exact(x, i, j, threshold)
            if not len(i):
                continue
            c, n = np.asarray(g.column("c")), np.asarray(g.column("n"))
            seen, at = np.unique(c[np.r_[i, j]], return_inverse=True)
            total = np.zeros(len(seen), dtype=np.int64)
            np.add.at(total, at, n[np.r_[j, i]])
            r, root = _forest(len(c), i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[seen, c[r]]), pa.array(np.r_[np.zeros(len(seen), dtype=np.int64), c[root]], mask=np.r_[np.ones(len(seen), dtype=bool), np.zeros(len(r), dtype=bool)]), pa.array(np.r_[total, np.zeros(len(r), dtype=np.int64)])],
                names=["a", "b", "n"],
            )

    groups = lambda df: df.repartition("key", "pair").sortWithinPartitions("key", "pair", "own")
    asked = cut(groups(d).mapInArrow(ask, "key bigint, pair bigint, own int, c bigint"))
    told = asked.join(stored, "c").select("key", "pair", "own", "c", "n", "q", "f", "step", "embedding")
    found = groups(told).mapInArrow(settle, "a bigint, b bigint, n bigint")
    return found.unionByName(stored.select(F.col("c").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n")))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors that are NULL, zero, not finite or incomplete have no links and are kept. Only vectors of one length link.
    Rows repeated exactly count as one vector; rows of one vec_id with different vectors pool their links.
    A NULL vec_id has no links, a NULL component and is kept. An empty table gives no rows.
    """
    e = F.col("embedding")
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    v = v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.size("embedding"), "embedding")})
    usable = v.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    members = cut(usable.select("vec_id", "h1", "h2").distinct())
    counts = members.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    alike = usable.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).join(counts, ["h1", "h2"])
    classes = cut(alike.withColumn("c", F.monotonically_increasing_id()))
    shapes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    if not shapes:
        return v.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    own = lambda x: (classes.filter(F.size("embedding") == x.dim) if len(shapes) > 1 else classes).select("c", "n", "embedding")
    found = cut(reduce(DataFrame.unionByName, (links(own(x), x.n, x.dim, threshold, recall) for x in shapes)))
    n = found.filter("b IS NULL").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    named = cut(classes.select("c", "h1", "h2", "low", (F.col("n") - 1).alias("more")).join(n, "c").withColumn("n_links", F.col("links") + F.col("more")))
    # components are of the classes' lowest ids; an id with several vectors joins their classes
    lows = named.select("c", "low")
    edges = found.filter("b IS NOT NULL AND a <> b").join(lows.toDF("a", "x"), "a").join(lows.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    of = members.join(named.select("h1", "h2", "low", "n_links"), ["h1", "h2"])
    both = of.groupBy("vec_id").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.collect_set("low").alias("s"), F.sum("n_links").alias("n_links"))
    both = cut(both)
    several = both.filter("a <> b").select("a", F.explode("s").alias("b")).filter("a <> b")
    c = components(edges.unionByName(several)).select(F.col("node").alias("a"), "component")
    told = both.join(c, "a", "left").select("vec_id", "n_links", F.coalesce("component", "a").alias("component_id"))
    comp = F.coalesce("component_id", "vec_id")
    return v.select("vec_id").join(told, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1),
c AS (SELECT a AS vec_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
