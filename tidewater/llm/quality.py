"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise term is computed in time
linear in the features by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted on at most `sample` labelled rows, those with the smallest hashes of their doc_id;
features of those rows alone come to the driver. Every document is then scored where it lies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, map_texts, slices, table

SAMPLE = 6000
WORD_SPACE = 1 << 14
STATS = 12
BINS = 12
RANK = 8
EPOCHS = 12
BATCH = 128
#: Small samples are gone over until so many steps are made.
LEAST_STEPS = 600
RATE = 0.05
L2 = 1e-5
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
SHAPE_SPACE = 1 << 10
WORDS_AT = STATS * BINS + SHAPE_SPACE
SIZE = WORDS_AT + WORD_SPACE
RUNS = re.compile(r"(.)\1+")
SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})
CACHE = 100_000
#: Features are held of so many rows, or bytes of text, at a time.
ROWS, TEXT_BYTES = 256, 1 << 20


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure and size of a text, each as a share or a logarithm."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    digits = sum(map(text.count, "0123456789"))
    space = sum(map(text.count, " \n\t"))
    marks = sum(map(text.count, "*#$%&@~^+=<>"))
    bars = sum(map(text.count, "|/\\{}[]_"))
    points = sum(map(text.count, ".,;:!?"))
    letters = len(text) - digits - space - marks - bars - points  # and what few other signs there are
    return [
        math.log1p(len(text)) / 12,  # the text's size, the one piece of metadata that is not forbidden
        letters / n,
        digits / n * 4,
        marks / n * 8,
        bars / n * 16,
        points / m * 2,
        len("".join(words)) / m / 16,
        len(set(words)) / m,
        (len(lines) - len(set(lines))) / len(lines),
        math.log1p(m / len(lines)) / 8,
        sum(w[:1].isupper() for w in words) / m,
        space / n * 3,
    ]


def shape(word: str) -> str:
    """A word's pattern of letters, digits and signs, with runs of one kind written once."""
    return RUNS.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else c for c in word.translate(SHAPE)))[:8]


def features(text: str | None, cache: dict[str, tuple[int, int]]) -> tuple[list[int], list[float]]:
    """Indices and values. Each statistic lights one of its bins; hashed words, and their hashed shapes, share a unit norm each."""
    text = text or ""
    words = text.split()
    idx, val = [], []
    for i, x in enumerate(statistics(text, words)):
        idx.append(i * BINS + min(BINS - 1, max(0, int(x * BINS))))
        val.append(0.5)
    each: dict[int, int] = {}
    kinds: dict[int, int] = {}
    for w in words:
        k = cache.get(w)
        if k is None:
            if len(cache) >= CACHE:
                cache.clear()
            code = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
            k = cache[w] = (WORDS_AT + code % WORD_SPACE, STATS * BINS + zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % SHAPE_SPACE)
        each[k[0]] = each.get(k[0], 0) + 1
        kinds[k[1]] = kinds.get(k[1], 0) + 1
    for counts in (each, kinds):
        if counts:
            x = np.log1p(np.fromiter(counts.values(), float, len(counts)))
            idx += counts.keys()
            val += (x / np.sqrt((x * x).sum())).tolist()
    return idx, val


def _flat(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(r[0]) for r in rows]
    return (
        np.fromiter((i for r in rows for i in r[0]), np.int64, sum(sizes)),
        np.fromiter((x for r in rows for x in r[1]), np.float64, sum(sizes)),
        np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64),
    )


def margins(m: Machine, idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid; every row has features, so no run is empty."""
    xv = m.v[idx] * val[:, None]
    s, q = np.add.reduceat(xv, at, axis=0), np.add.reduceat(xv * xv, at, axis=0)
    return m.w0 + np.add.reduceat(m.w[idx] * val, at) + 0.5 * (s * s - q).sum(1)


def score(m: Machine, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    """Probabilities, in slices so that the factors of few rows are held at once."""
    out = [np.zeros(0)]
    for i in range(0, len(rows), 256):
        z = margins(m, *_flat(rows[i : i + 256]))
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out)


def scores(m: Machine, texts: pa.Array, cache: dict[str, tuple[int, int]]) -> np.ndarray:
    """score() of a column of texts; the features of one slice are gone before those of the next are made."""
    out = [np.zeros(0)]
    for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), TEXT_BYTES, ROWS):
        out.append(score(m, [features(t, cache) for t in s.column(0).to_pylist()]))
    return np.concatenate(out)


def train(rows: list[tuple[list[int], list[float]]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad over mini-batches of the log loss. Without rows of both labels the score is the smoothed label share."""
    rng = np.random.default_rng(seed)
    pos = float(labels.sum())
    m = Machine(math.log((pos + 1) / (len(labels) - pos + 1)), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if len(set(labels.tolist())) < 2:
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(max(EPOCHS, math.ceil(LEAST_STEPS * BATCH / len(rows)))):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            idx, val, at = _flat([rows[k] for k in pick])
            row = np.repeat(np.arange(len(pick)), np.diff(np.r_[at, len(idx)]))
            xv = m.v[idx] * val[:, None]
            s = np.add.reduceat(xv, at, axis=0)
            z = m.w0 + np.add.reduceat(m.w[idx] * val, at) + 0.5 * (s * s - np.add.reduceat(xv * xv, at, axis=0)).sum(1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, d[row] * val, len(used)) + L2 * m.w[used]
            part = d[row, None] * val[:, None] * (s[row] - xv)
            dv = np.stack([np.bincount(where, part[:, f], len(used)) for f in range(RANK)], 1) + L2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            g0 += d.sum() ** 2
            m.w0 -= RATE * d.sum() / math.sqrt(g0)
    return m


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from labelled rows outside the held-out fold. An id with several labels counts by their mean, rounded."""
    y = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.round(F.avg("quality")).alias("y"))
    y = y.filter(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = d.join(F.broadcast(y), "doc_id")  # at most `sample` ids

    def run(c: dict[str, list]) -> dict[str, list]:
        f = [features(t, {}) for t in c["text"]]
        return {"o": c["o"], "y": c["y"], "i": [x[0] for x in f], "x": [x[1] for x in f]}

    got = map_rows(rows.select(F.xxhash64("doc_id", "text").alias("o"), "y", "text"), "o bigint, y double, i array<int>, x array<float>", run)
    # an id repeated in documents brings several rows; the bound holds for rows as well
    got = got.orderBy("o").limit(sample).toArrow()
    order = np.argsort(np.asarray(got.column("o")), kind="stable")
    idx, val = got.column("i").to_pylist(), got.column("x").to_pylist()
    return train([(idx[k], val[k]) for k in order], np.asarray(got.column("y"))[order])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    NULL and empty texts are scored by their statistics alone. A NULL doc_id counts as held out.
    """
    handle = docs.sparkSession.sparkContext.broadcast(machine)
    cache: dict[str, tuple[int, int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(handle.value, b.column("text"), cache)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id").cast("bigint")) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs whose text scores at least the threshold; no shuffle."""
    handle = docs.sparkSession.sparkContext.broadcast(machine)
    cache: dict[str, tuple[int, int]] = {}

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(handle.value, b.column(at), cache) >= THRESHOLD))

    return map_texts(docs, run)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
