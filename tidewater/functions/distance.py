"""Squared L2 distance: an expression for few pairs and Arrow kernels for many.

Distances are sums of squared differences in double precision, so ties stay ties. The kernels rank by
|x|^2 - 2xc + |c|^2 first, one matrix product, and work out the differences only of pairs that may be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 256 << 20
#: So many queries are compared with a batch of vectors at once.
QUERY_BLOCK = 1024
#: Pairs whose quick distances are held at once.
TABLE = 1 << 21


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences; NULL if an argument is NULL or the lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def matrix(df: DataFrame, key: str, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A small table as (ids, matrix) on the driver, its size checked first."""
    d = df.select(F.count("*"), F.max(F.size(column))).first()
    if d[0] * (d[1] or 0) * 8 > MAX_BROADCAST_BYTES:
        raise ValueError(f"{d[0]} x {d[1]} doubles exceed the {MAX_BROADCAST_BYTES} byte bound of a broadcast matrix")
    rows = df.select(key, column).orderBy(key).collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def blocks(df: DataFrame, key: str, column: str) -> list[DataFrame]:
    """The table in parts that each stay well below the bound of a broadcast matrix."""
    d = df.select(F.count("*"), F.max(F.size(column))).first()
    n = 1 + d[0] * (d[1] or 0) * 16 // MAX_BROADCAST_BYTES
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def batch_matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def best_of(x: np.ndarray, c: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in c, distances) of the k nearest rows of c to each row of x by (distance, place); -1 and inf where there are fewer.

    skip marks pairs that do not count. NaN and infinite distances never enter.
    """
    k = min(k, len(c))
    if not k or not len(x):
        return np.full((len(x), k), -1), np.full((len(x), k), np.inf)
    step = max(1, TABLE // len(c))
    if len(x) > step:  # so many pairs at a time
        parts = [best_of(x[i : i + step], c, k, None if skip is None else skip[i : i + step]) for i in range(0, len(x), step)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([d for _, d in parts])
    with np.errstate(all="ignore"):
        xx, cc = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
        near = xx[:, None] + cc - 2 * (x @ c.T)
        slack = 1e-12 * (xx + cc.max(initial=0, where=np.isfinite(cc)))
    odd = ~np.isfinite(near)
    if skip is not None:
        odd |= skip
    near[odd] = np.inf
    # a pair whose quick value is not finite may have a finite distance: rows of such pairs are worked out whole
    whole = (odd if skip is None else odd & ~skip).any(1)
    limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * np.where(np.isfinite(slack), slack, np.inf)
    want = near <= limit[:, None]
    want[whole] = True
    if skip is not None:
        want &= ~skip
    row, col = np.nonzero(want)
    dist = np.empty(len(row))
    step = max(1, (4 << 20) // max(1, x.shape[1]))
    with np.errstate(all="ignore"):
        for i in range(0, len(row), step):
            d = x[row[i : i + step]] - c[col[i : i + step]]
            dist[i : i + step] = np.einsum("ij,ij->i", d, d)
    ok = np.isfinite(dist)
    row, col, dist = row[ok], col[ok], dist[ok]
    order = np.lexsort((col, dist, row))
    row, col, dist = row[order], col[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    at, out = np.full((len(x), k), -1), np.full((len(x), k), np.inf)
    at[row[top], rank[top]] = col[top]
    out[row[top], rank[top]] = dist[top]
    return at, out


def nearest(vectors: DataFrame, ids: np.ndarray, mat: np.ndarray, key: str, k: int, out_key: str) -> DataFrame:
    """Rows (key, rank, out_key, dist): the k nearest matrix rows of each vector by (dist, id); NaN and inf never enter."""
    handle = vectors.sparkSession.sparkContext.broadcast((ids, mat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = handle.value
        for b in batches:
            if not b.num_rows:
                continue
            order, dist = best_of(batch_matrix(b, "embedding"), mat, k)
            ok = order >= 0
            own = np.repeat(np.asarray(b.column(b.schema.get_field_index(key))), order.shape[1]).reshape(order.shape)
            rank = np.broadcast_to(np.arange(1, order.shape[1] + 1, dtype=np.int32), order.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[ok]), pa.array(rank[ok]), pa.array(ids[order][ok]), pa.array(dist[ok])],
                names=[key, "rank", out_key, "dist"],
            )

    return vectors.select(key, "embedding").mapInArrow(run, f"{key} bigint, rank int, {out_key} bigint, dist double")


def partial_topk(
    vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None, probes: dict[int, np.ndarray] | None = None, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (query_id, vec_id, dist, *extra): of each partition its k vectors nearest to each query by (dist, vec_id).

    A task holds k rows a query, however many batches it reads. own: the vec_id that each query does not count.
    probes: by cluster_id, the places of the queries that look there; vectors of other clusters are passed over.
    """
    handle = vectors.sparkSession.sparkContext.broadcast((ids, queries, own, probes))
    carried = ("vec_id", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, own, probes = handle.value
        best = np.full((len(ids), k), np.inf)
        rows = [np.full((len(ids), k), np.iinfo(np.int64).max) for _ in carried]

        def take(asked: np.ndarray, x: np.ndarray, cols: list[np.ndarray]) -> None:
            for i in range(0, len(asked), QUERY_BLOCK):
                at = asked[i : i + QUERY_BLOCK]
                skip = None if own is None else own[at, None] == cols[0][None, :]
                place, dist = best_of(q[at], x, k, skip)
                new = [np.concatenate([r[at], np.where(place >= 0, c[place], np.iinfo(np.int64).max)], axis=1) for r, c in zip(rows, cols, strict=True)]
                both = np.concatenate([best[at], dist], axis=1)
                order = np.lexsort((new[0], both), axis=1)[:, :k]
                best[at] = np.take_along_axis(both, order, 1)
                for r, n in zip(rows, new, strict=True):
                    r[at] = np.take_along_axis(n, order, 1)

        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: np.asarray(b.column(b.schema.get_field_index(c)))
            by = np.argsort(get("vec_id"), kind="stable")
            x, cols = batch_matrix(b, "embedding")[by], [get(c)[by] for c in carried]
            if probes is None:
                take(np.arange(len(ids)), x, cols)
                continue
            cluster = get("cluster_id")[by]
            for c in np.unique(cluster).tolist():
                if c in probes:
                    here = cluster == c
                    take(probes[c], x[here], [v[here] for v in cols])
        ok = np.isfinite(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(ids[:, None], best.shape)[ok]), pa.array(rows[0][ok]), pa.array(best[ok]), *(pa.array(r[ok]) for r in rows[1:])],
            names=["query_id", "vec_id", "dist", *extra],
        )

    schema = ", ".join(["query_id bigint, vec_id bigint, dist double", *(f"{c} bigint" for c in extra)])
    return vectors.select("vec_id", "embedding", *extra, *(["cluster_id"] if probes is not None else [])).mapInArrow(run, schema)
