"""Substring deduplication by relative Lempel-Ziv parsing against every document.

Every document is a reference block for all later ones. The index that finds a factor's source holds
winnowed seeds: of the SEED-word sequences in a window, the one with the least hash. Equal windows choose the
same seed, so a window can occur elsewhere only if its seed does; only windows of seeds that occur twice
are looked up whole. A window whose first occurrence lies elsewhere continues a factor; maximal runs of such
windows are the factors, and since every window is judged, those over factor boundaries are judged too.

Copies of a whole text need no parsing: every window of theirs starts earlier in the first copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_rows

WINDOW = 20
SEED = 8
#: Counted rows up to which a table of marks is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CACHE = 400_000


def _inverse(b: int) -> int:
    x = b
    for _ in range(6):
        x = x * (2 - b * x) & 0xFFFFFFFFFFFFFFFF
    return x


class Hasher:
    """Rolling hashes of word sequences, modulo 2^64; word hashes are kept for words seen before."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.powers = {b: np.ones(1, dtype=np.uint64) for base in BASES for b in (base, _inverse(base))}

    def words(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        w = (text or "").encode("utf-8", "surrogatepass").split()
        get, cache = self.cache.get, self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = np.empty(len(w), dtype=np.uint64)
        for i, x in enumerate(w):
            h = get(x)
            if h is None:
                h = cache[x] = xxhash.xxh3_64_intdigest(x)
            out[i] = h
        return w, out

    def _power(self, b: int, n: int) -> np.ndarray:
        p = self.powers[b]
        if len(p) < n:
            p = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(p)) - 1, b, dtype=np.uint64))))
            self.powers[b] = p
        return p[:n]

    def runs(self, h: np.ndarray, k: int, base: int) -> np.ndarray:
        """The hash of each k consecutive word hashes."""
        n = len(h) - k + 1
        if n < 1:
            return np.zeros(0, dtype=np.uint64)
        x = h if base == BASES[0] else (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x * self._power(base, len(h)), dtype=np.uint64)))
        r = (total[k:] - total[:-k]) * self._power(_inverse(base), n)
        r ^= r >> np.uint64(32)
        r *= np.uint64(0xD6E8FEB86659FD93)
        return r ^ (r >> np.uint64(32))


def chosen(seeds: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The least seed hash of each window."""
    n = window - seed + 1
    out = seeds[: len(seeds) - n + 1].copy()
    for i in range(1, n):
        np.minimum(out, seeds[i : len(seeds) - n + 1 + i], out=out)
    return out


def selected(seeds: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The hash of each seed that some window chooses, once for each place; the leftmost of equals is chosen."""
    n = window - seed + 1
    m = len(seeds) - n + 1
    low, at = seeds[:m].copy(), np.arange(m)
    for i in range(1, n):
        x = seeds[i : m + i]
        less = x < low
        np.copyto(low, x, where=less)
        at[less] = np.flatnonzero(less) + i
    return low[np.r_[True, at[1:] != at[:-1]]]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, ord (its place in the order, NULL last) and two hashes that together name the text."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("ord"),
        F.xxhash64("text").alias("t1"),
        F.xxhash64(F.lit(1), "text").alias("t2"),
    )


def parse(h: Hasher, text: str | None, seeds: set[int] | None, first: np.ndarray | None, window: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    """Words and which of them lie in a factor. first: starts of the windows that occur nowhere earlier, among those of repeated seeds."""
    words, hashes = h.words(text)
    dead = np.zeros(len(words) + 1, dtype=np.int64)
    if seeds and len(words) >= window:
        again = np.isin(chosen(h.runs(hashes, seed, BASES[0]), window, seed), np.fromiter(seeds, np.int64, len(seeds)).view(np.uint64))
        if first is not None:
            again[first] = False
        at = np.flatnonzero(again)
        np.add.at(dead, at, 1)
        np.add.at(dead, at + window, -1)
    return words, np.cumsum(dead)[:-1] > 0


def removed(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, n_factors) for each row of docs (doc_id, text).

    A word goes if a window over it starts earlier: in a smaller doc_id (NULL is the largest), or in the same
    document. Rows of one doc_id with different texts are ordered by text hash; exact repetitions of a row
    share its result. A text of fewer words than a window loses none. An empty table gives no rows.
    """
    k = _keyed(docs)
    copies = cut(k.groupBy("t1", "t2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").select("t1", "t2", "first"))
    rows = copies.count()
    d = k.join(_sized(copies, rows), ["t1", "t2"], "left").select("doc_id", "text", "ord", "t1", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)).alias("copy"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A seed that occurs twice in a batch is settled here: its rows go on as marks, and one row stands for the
        # batch in the search across batches. So a seed that is everywhere brings one row a batch to its task.
        h = Hasher()
        for b in batches:
            s, t = [], []
            for text, t1 in zip(b.column("text").to_pylist(), b.column("t1").to_pylist(), strict=True):
                x = h.words(text)[1]
                if len(x) >= window:
                    p = selected(h.runs(x, seed, BASES[0]), window, seed)
                    s.append(p.view(np.int64))
                    t.append(np.full(len(p), t1, dtype=np.int64))
            if s:
                s, t = np.concatenate(s), np.concatenate(t)
                _, at, back, n = np.unique(s, return_index=True, return_inverse=True, return_counts=True)
                many = n[back] > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[s[at], t[many]]), pa.array(np.r_[t[at], s[many]]), pa.array(np.r_[np.zeros(len(at), dtype=bool), np.ones(int(many.sum()), dtype=bool)])],
                    names=["key", "other", "settled"],
                )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows sorted by key: a seed row whose neighbour has its key is a repeated seed. One row is held back.
        held: tuple[int, int, bool] | None = None
        for b in batches:
            key, other, settled = (np.asarray(b.column(c)) for c in ("key", "other", "settled"))
            mark = settled
            yield pa.RecordBatch.from_arrays([pa.array(key[mark]), pa.array(other[mark])], names=["t1", "seed"])
            key, other = key[~mark], other[~mark]
            if not len(key):
                continue
            same = np.r_[held is not None and held[0] == key[0], key[1:] == key[:-1]]
            twice = same | np.r_[same[1:], False]
            if held is not None and (held[2] or same[0]):
                yield pa.RecordBatch.from_arrays([pa.array([held[1]]), pa.array([held[0]])], names=["t1", "seed"])
            yield pa.RecordBatch.from_arrays([pa.array(other[:-1][twice[:-1]]), pa.array(key[:-1][twice[:-1]])], names=["t1", "seed"])
            held = (int(key[-1]), int(other[-1]), bool(twice[-1]))
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[1]]), pa.array([held[0]])], names=["t1", "seed"])

    # a row repeated exactly brings its seeds twice; that only adds look-ups
    index = d.filter(~F.col("copy")).select("text", "t1").mapInArrow(seeds, "key bigint, other bigint, settled boolean")
    found = index.repartition("key").sortWithinPartitions("settled", "key").mapInArrow(again, "t1 bigint, seed bigint")
    marks = cut(found.groupBy("t1").agg(F.collect_set("seed").alias("seeds")))  # at most a document's own seeds

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for text, o, t1, copy, ss in zip(*(b.column(c).to_pylist() for c in ("text", "ord", "t1", "copy", "seeds")), strict=True):
                if copy:
                    continue
                x = h.words(text)[1]
                hit = np.isin(chosen(h.runs(x, seed, BASES[0]), window, seed), np.array(ss, dtype=np.int64).view(np.uint64))
                at = np.flatnonzero(hit)
                w1, w2 = (h.runs(x, window, base)[at].view(np.int64) for base in BASES)
                for c, v in zip(out, (w1, w2, np.full(len(at), o, dtype=np.int64), np.full(len(at), t1, dtype=np.int64), at.astype(np.int32)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "ord", "t1", "pos"])

    # both joins with the texts read the same columns, so that Spark moves the texts once
    asked = d.join(marks, "t1").mapInArrow(wanted, "w1 bigint, w2 bigint, ord bigint, t1 bigint, pos int")
    firsts = asked.groupBy("w1", "w2").agg(F.min(F.struct("ord", "t1", "pos")).alias("m"))
    won = firsts.groupBy(F.col("m.t1").alias("t1")).agg(F.collect_list("m.pos").alias("firsts"))  # at most a document's own windows
    told = marks.join(won, "t1", "left")

    def final(c: dict[str, list]) -> dict[str, list]:
        if not hasher:
            hasher.append(Hasher())
        h = hasher[0]
        out: dict[str, list] = {x: [] for x in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "n_factors")}
        for i, text in enumerate(c["text"]):
            if c["copy"][i]:
                w = (text or "").encode("utf-8", "surrogatepass").split()
                dead = np.full(len(w), len(w) >= window)
            else:
                first = np.array(c["firsts"][i], dtype=np.int64) if c["firsts"][i] else None
                w, dead = parse(h, text, set(c["seeds"][i] or ()), first, window, seed)
            kept = b" ".join(x for x, z in zip(w, dead.tolist(), strict=True) if not z) if len(w) else b""
            out["doc_id"].append(c["doc_id"][i])
            out["n_words"].append(len(w))
            out["n_removed"].append(int(dead.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "surrogatepass"))
            out["n_factors"].append(int(np.count_nonzero(np.diff(np.r_[0, dead.astype(np.int8)]) == 1)))
        return out

    hasher: list[Hasher] = []
    return map_rows(d.join(told, "t1", "left"), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, n_factors bigint", final)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest([md5(array_to_string(w[i:i+19], ' ')) for i in range(1, len(w) - 18)]) AS h, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
dead AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
edge AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS DISTINCT FROM p - 1 AS fresh FROM dead),
gone AS (SELECT doc_id, count(*) AS n, count(*) FILTER (fresh) AS f FROM edge GROUP BY 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN dead USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(f, 0)::BIGINT AS n_factors
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
