"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into phrases,
each the longest match from its place in the language's text; the fewer phrases a character, the closer
the language. Phrase counts are normalised by log2 of the training length, the bits of a pointer into it.

Texts are parsed in lanes of LANE characters, many lanes in step over a table of the automaton's edges: a phrase
also ends where a lane ends, which adds at most one phrase a lane and the same for every language. The table is
hashed, so its size is that of the training text, however many letters the languages have.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, table

#: Bounds of the training sample: characters and documents a language.
TRAIN_CHARS = 40_000
TRAIN_DOCS = 200
#: Characters of all languages together: with more than ALL_CHARS / TRAIN_CHARS languages, each has an equal share of
#: them, so that what is sent to every worker has a bound (about 150 bytes a character).
ALL_CHARS = 1_000_000
#: The smallest hashes of a language are sought in so many parts first, so that what one task sorts has a bound.
PARTS = 16
LANE = 256
FOLDS, HELD_OUT = 3, 1
LETTER = re.compile(r"[^\W\d_]")
OTHER = 1  # symbol of everything that is not a letter; 0 is an unseen letter


class Edges:
    """(state, symbol) -> state in an open-addressed table; 0 is no transition and 1 the root, whose edges are kept apart too."""

    def __init__(self, states: list[dict[int, int]], width: int):
        self.width, self.states = width, len(states)
        n = sum(map(len, states))
        key = np.fromiter((i * width + c for i, d in enumerate(states) for c in d), np.int64, n)
        to = np.fromiter((t for d in states for t in d.values()), np.int32, n)
        self.mask = (1 << max(4, (4 * n).bit_length())) - 1
        self.key, self.to = np.full(self.mask + 1, -1, dtype=np.int64), np.zeros(self.mask + 1, dtype=np.int32)
        at = self._slot(key)
        while len(key):  # the first of those that want an empty place takes it, the others go on
            _, first = np.unique(at, return_index=True)
            first = first[self.key[at[first]] < 0]
            self.key[at[first]], self.to[at[first]] = key[first], to[first]
            left = np.ones(len(key), dtype=bool)
            left[first] = False
            key, to, at = key[left], to[left], (at[left] + 1) & self.mask
        self.root = np.zeros(width, dtype=np.int64)
        for c, t in states[1].items():
            self.root[c] = t

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(36)).astype(np.int64) & self.mask

    def go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol each; 0 where there is no transition."""
        key = state * self.width + symbol
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.to[at], 0).astype(np.int64)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def __getitem__(self, at: tuple[int, int]) -> int:
        return int(self.go(np.array([at[0]], dtype=np.int64), np.array([at[1]], dtype=np.int64))[0])

    def nbytes(self) -> int:
        return self.key.nbytes + self.to.nbytes + self.root.nbytes


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # code point -> symbol, up to its length
    tables: list[Edges]
    bits: list[float]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def suffix_automaton(seq: list[int], width: int) -> Edges:
    """The edges of the suffix automaton of a sequence of symbols; state 1 is the root."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, size, last = [0, 0], [0, 0], 1
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        size.append(size[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return Edges(nxt, width)


def _symbolise(points: np.ndarray, table: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without repeats of OTHER, and which points they come from. No repeat is dropped over a text's start."""
    s = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0).astype(np.int32)
    far = np.flatnonzero((points >= len(table)))
    if len(far):
        s[far] = np.fromiter((0 if chr(x).isalpha() else OTHER for x in points[far].tolist()), np.int32, len(far))
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != OTHER) | (s[:-1] != OTHER)
    if breaks is not None:
        keep[breaks] = True
    return s[keep], keep


def learn(samples: dict[str, list[str]], most: int = TRAIN_CHARS) -> Model:
    langs = sorted(samples)
    seen = np.unique(np.concatenate([codes("".join(samples[k])) for k in langs])) if langs else np.zeros(0, dtype=np.uint32)
    letters = [int(x) for x in seen if chr(int(x)).isalpha()]
    table = np.zeros(max([0x250, *(x + 1 for x in letters)]), dtype=np.int32)
    for x in range(len(table)):
        table[x] = 0 if 0xD800 <= x < 0xE000 or chr(x).isalpha() else OTHER
    for i, x in enumerate(letters):
        table[x] = i + 2
    tables, bits = [], []
    for k in langs:
        seq = _symbolise(codes("\n".join(samples[k])), table)[0][:most]
        tables.append(suffix_automaton(seq.tolist(), len(letters) + 2))
        bits.append(math.log2(len(seq) + 2))
    return Model(langs, table, tables, bits)


def phrases(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of each text and language, symbols of each text)."""
    parts = [codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    s, keep = _symbolise(flat, m.symbols, starts[sizes > 0])
    length = np.bincount(own[keep], minlength=len(texts))
    lanes = -(-length // LANE)
    lane_text = np.repeat(np.arange(len(texts)), lanes)
    first = np.r_[0, np.cumsum(length)[:-1]]
    inner = np.arange(len(lane_text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = first[lane_text] + inner * LANE
    count = np.minimum(LANE, length[lane_text] - inner * LANE)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    live = np.searchsorted(-count, -np.arange(LANE), side="left")  # lanes longer than each step
    out = np.zeros((len(texts), len(m.langs)))
    for k, t in enumerate(m.tables):
        root = t.root
        state = np.ones(len(begin), dtype=np.int64)
        got = np.zeros(len(begin), dtype=np.int64)
        for i in range(LANE):
            n = int(live[i])
            if not n:
                break
            c = s[begin[:n] + i]
            to = t.go(state[:n], c)
            # a phrase begins at the root; where none goes on, the symbol begins the next one, or is one of its own
            # if the language lacks it, after which the root is left again
            miss = to == 0
            got[:n] += miss | (state[:n] == 1)
            state[:n] = np.where(miss, np.maximum(root[c], 1), to)
        out[:, k] = np.bincount(lane_text[order], got, len(texts))
    return out, length


def predict(m: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score. The score is the runner-up's share of the two smallest entropies: 0.5 for a tie, towards 1 for a sure win."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if m.langs else []
    step: list[int] = []
    chars = 0
    for j, i in enumerate(use):
        step.append(i)
        chars += len(texts[i])
        if chars > 4 << 20 or j == len(use) - 1:
            p, n = phrases(m, [texts[k] for k in step])
            h = p * np.array(m.bits) / np.maximum(n, 1)[:, None]
            best = h.argmin(1)
            two = np.sort(h, 1)
            for r, k in enumerate(step):
                lang[k] = m.langs[best[r]]
                score[k] = 1.0 if h.shape[1] == 1 else float(two[r, 1] / (two[r, 0] + two[r, 1]))
            step, chars = [], 0
    return lang, score


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


def fit(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of rows outside the held-out fold.

    Distinct texts of each language are taken in the order of their hashes until TRAIN_CHARS (its share of
    ALL_CHARS, if that is less) or TRAIN_DOCS is reached; whole texts are considered and only those come to the driver.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter((fold(F.col("doc_id").cast("bigint")) != HELD_OUT) & F.col("lang").isNotNull())
    d = d.filter(F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    texts = d.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    most = min(TRAIN_CHARS, ALL_CHARS // max(1, d.select("lang").distinct().count()))
    w = Window.partitionBy("lang").orderBy("h")
    part = Window.partitionBy("lang", "part").orderBy("h")
    few = texts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= TRAIN_DOCS)
    low = few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= TRAIN_DOCS)
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pick = cut(low.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < most).select("lang", "h"))
    rows = d.join(F.broadcast(pick), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").toLocalIterator()
    samples: dict[str, list[str]] = {}
    have: dict[str, int] = {}
    for r in rows:
        if have.get(r.lang, 0) < most:
            samples.setdefault(r.lang, []).append(r.text)
            have[r.lang] = have.get(r.lang, 0) + len(r.text)
    return learn(samples, most)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text); `und` and 0 without a letter.

    A NULL doc_id counts as held out. No shuffle; whole texts.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(c: dict[str, list]) -> dict[str, list]:
        lang, score = predict(handle.value, c["text"])
        return {"doc_id": c["doc_id"], "held_out": c["held_out"], "lang_pred": lang, "score": score}

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id").cast("bigint")) == HELD_OUT).alias("held_out"), "text")
    return map_rows(d, "doc_id bigint, held_out boolean, lang_pred string, score double", run)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs, fit(docs))
