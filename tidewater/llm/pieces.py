"""SentencePiece encoding and decoding as a max-plus parallel scan.

The vocabulary is one of merges: from single characters on, the neighbours whose joint piece scores best merge, the
leftmost of equals first. A sequence of pieces is the result of these merges if and only if each piece by itself, and
each two neighbours by themselves, merge to just what they are: until a first merge over a border, the pieces on its
two sides take the same steps in the same order as they do alone. So the encoding is a path over pieces whose
neighbours fit, with value 0 for a pair that fits and minus infinity for one that does not, and it is the only path
above minus infinity: the encoding of every beginning of a text ends in one piece only.

A giant document is split into chunks, which are rows of their own. The states at a border are the pieces of the
vocabulary that begin before it and end at or after it in the text. A chunk is worked into the matrix from each state
at its begin to each state at its end. Matrices combine associatively under (max, +), in a tree of groups; the states
on the path are read off the combined matrices from the top down, and each chunk is then traced back on its own
between its two states.

No piece crosses the place before a space that follows another sign, or around a line break. Stretches between such
places are solved once and remembered; a chunk's matrix is then that of its head and its tail.

Spaces take the place of the vocabulary's word mark, and a text gets one in front. A character that the
vocabulary lacks becomes its UTF-8 bytes. So does the word mark itself, where the library would take it for a space:
decoding gives back every text exactly, and every text without a word mark has the ids of the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, slices

MARK = "▁"
#: Texts of more characters are split into chunks and spread over tasks.
GIANT = 1 << 15
CHUNK = 1 << 13
#: Chunk matrices of one document that are combined at a time.
FAN = 256
NONE = -(1 << 62)
#: Stretches of up to so many characters are remembered, CACHE of them a worker.
REMEMBERED = 64
CACHE = 500_000
#: Pairs of pieces that solve() remembers.
FITS = 100_000
#: Places for pairs of pieces and whether they fit; a newer pair takes an older one's place.
PAIRS = 1 << 21
HARD = re.compile(r"(?<=[^ ]) |(?<=\n).|\n", re.S)  # where no piece can cross
STRETCH = re.compile(r" *[^ \n]+|\n| +")
START = -1  # stands for the piece before a text or stretch, which fits to any that merges to itself


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def model_bytes(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


class Pieces:
    """A vocabulary read for encoding. Built once a worker from the model's bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.text_of: dict[int, str] = {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                p = p.replace(MARK, " ")
                self.pieces[p] = (i, sp.get_score(i))
                self.text_of[i] = p
                self.bytes_of.append(p.encode())
        if 0 in self.byte_ids[1:]:
            raise ValueError("the vocabulary has no byte pieces; unknown characters could not be decoded")
        if any(re.search(r"[^ ] |\n.|.\n", p, re.S) for p in self.pieces):
            raise ValueError("the vocabulary has pieces across word starts or line breaks")
        self.first = len(self.bytes_of)  # the id that START has in pairs
        self.begins: set[str] = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.width = max(map(len, self.pieces), default=1)
        self.ids_of: dict[str, bytes] = {}
        self.fit: dict[tuple[str, str], bool] = {}
        self.memo = np.full(PAIRS, -1, dtype=np.int64)
        self._trie()

    def _trie(self) -> None:
        """The pieces as a trie whose edges (node, character) lie in an open-addressed table, for look-ups of whole arrays."""
        names = sorted(self.begins, key=len)
        number = {"": 0} | {b: i + 1 for i, b in enumerate(names)}
        keys = np.array([(number[b[:-1]] << 21) + ord(b[-1]) for b in names], dtype=np.uint64)
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.edge_key = np.full(self.mask + 1, (1 << 64) - 1, dtype=np.uint64)
        self.edge_to = np.zeros(self.mask + 1, dtype=np.int64)
        for k, h, to in zip(keys.tolist(), self._slot(keys).tolist(), range(1, len(keys) + 1), strict=True):
            while self.edge_key[h] != (1 << 64) - 1:
                h = (h + 1) & self.mask
            self.edge_key[h], self.edge_to[h] = k, to
        self.node_id = np.array([-1] + [self.pieces[b][0] if b in self.pieces else -1 for b in names], dtype=np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character; 0 if there is none."""
        key = (node.astype(np.uint64) << np.uint64(21)) + char
        h = self._slot(key)
        found = self.edge_key[h]
        out = np.where(found == key, self.edge_to[h], 0)
        open_ = np.flatnonzero((found != key) & (found != np.uint64((1 << 64) - 1)))
        while len(open_):
            h[open_] = (h[open_] + 1) & self.mask
            found = self.edge_key[h[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.edge_to[h[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64((1 << 64) - 1))]
        return out

    def fits(self, a: str, b: str) -> bool:
        """Whether the merges of a and b, written together, end in just the two; a is empty at the start."""
        if a and a + b in self.pieces:
            return False
        part, border, get = list(a + b), len(a), self.pieces.get
        while len(part) > 1:
            best, at = None, -1
            for i in range(len(part) - 1):
                p = get(part[i] + part[i + 1])
                if p and (best is None or p[1] > best):
                    best, at = p[1], i
            if best is None:
                break
            if at == border - 1:
                return False
            part[at : at + 2] = [part[at] + part[at + 1]]
            border -= at < border
        return part == ([a, b] if a else [b])

    def fitting(self, key: np.ndarray) -> np.ndarray:
        """fits() of many pairs, each as its first id times the number of ids and one, plus its second id."""
        h = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        found = self.memo[h]
        out = (found & 1).astype(bool)
        miss = np.flatnonzero(found >> 1 != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            text, n = self.text_of, self.first + 1
            ok = np.fromiter((self.fits(text.get(k // n, ""), text[k % n]) for k in new.tolist()), np.int64, len(new))
            out[miss] = ok[back] > 0
            self.memo[h[miss]] = (key[miss] << 1) + ok[back]
        return out

    def solve_many(self, words: list[str]) -> list[bytes]:
        """solve() for many stretches at once, place by place over all words."""
        words_at = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in words_at], dtype=np.int64)
        flat = np.frombuffer("".join(words[i] for i in words_at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        end = np.repeat(begin + size, size)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []  # (places, ids, length) of the pieces in the words
        at, node = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int64)
        strange = np.zeros(len(size), dtype=bool)
        for d in range(self.width):
            node = self._child(node, flat[at + d])
            ids = self.node_id[node]
            real = np.flatnonzero(ids >= 0)
            found.append((at[real], ids[real], d + 1))
            if d == 0:
                strange[word[ids < 0]] = True
            go = (node > 0) & (at + d + 1 < end[at])
            at, node = at[go], node[go]
            if not len(at):
                break
        place = np.concatenate([x for x, _, _ in found])
        ids = np.concatenate([x for _, x, _ in found])
        reach = np.repeat([d for _, _, d in found], [len(x) for x, _, _ in found])
        step = (place - begin[word[place]]).astype(np.int16 if len(size) and size[0] < 1 << 15 else np.int64)
        order = np.argsort(step, kind="stable")
        bounds = np.searchsorted(step[order], np.arange(int(size[0]) + 1 if len(size) else 1))
        # place t of a word is kept at begin + t + its number: each word has one place more than characters
        place, ids, reach = (place + word[place])[order], ids[order], reach[order]
        last = np.full(len(flat) + len(size), -1, dtype=np.int64)
        back = np.zeros(len(last), dtype=np.int64)
        number = np.arange(len(size))
        last[begin + number] = self.first
        for t in range(len(bounds) - 1):
            x = slice(bounds[t], bounds[t + 1])
            before = last[place[x]]
            ok = np.flatnonzero(before >= 0)
            ok = ok[self.fitting(before[ok] * (self.first + 1) + ids[x][ok])]
            to = (place[x] + reach[x])[ok]
            last[to], back[to] = ids[x][ok], reach[x][ok]
        stop = begin + number
        here, live = stop + size, number
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        strange |= last[here] < 0
        live = live[~strange & (size > 0)]
        while len(live):
            steps.append((live, last[here[live]]))
            here[live] -= back[here[live]]
            live = live[here[live] > stop[live]]
        out = [b""] * len(words)
        if steps:
            owner = np.concatenate([x for x, _ in steps])
            order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps]), owner))
            packed = np.concatenate([i for _, i in steps])[order].astype(np.int32).tobytes()
            upto = (np.cumsum(np.bincount(owner, minlength=len(size))) * 4).tolist()
            for i, f, e in zip(words_at, [0, *upto[:-1]], upto, strict=True):
                out[i] = packed[f:e]
        for j in np.flatnonzero(strange).tolist():
            out[words_at[j]] = self.solve(words[words_at[j]])
        return out

    def prepare(self, stretches: set[str]) -> None:
        """Remembers the solutions of short stretches that are not known yet."""
        new = [x for x in stretches if x not in self.ids_of and len(x) <= REMEMBERED]
        if len(self.ids_of) + len(new) > CACHE:
            self.ids_of.clear()
            new = [x for x in stretches if len(x) <= REMEMBERED]
        for k in range(0, len(new), 1 << 14):
            part = new[k : k + (1 << 14)]
            self.ids_of.update(zip(part, self.solve_many(part), strict=True))

    def ends(self, s: str, i: int) -> list[int]:
        """Where the pieces from place i of s end, shortest first; a character that is no piece is taken as one."""
        out = [i + 1]
        for e in range(i + 2, min(len(s), i + self.width) + 1):
            b = s[i:e]
            if b not in self.begins:
                break
            if b in self.pieces:
                out.append(e)
        return out

    def follows(self, a: str, b: str) -> bool:
        """fits(), remembered."""
        ok = self.fit.get((a, b))
        if ok is None:
            if len(self.fit) >= FITS:
                self.fit.clear()
            ok = self.fit[a, b] = self.fits(a, b)
        return ok

    def forward(self, s: str, entries: list[tuple[int, int]], stop: int) -> dict[int, dict[int, np.ndarray]]:
        """By place, and by the begin of the piece that ends there: the values from each entry (begin, end), pieces beginning before stop.

        A begin of START says that nothing stands before. Entries that come to the same piece go on as one.
        """
        at: dict[int, dict[int, np.ndarray]] = {}
        for k, (a, e) in enumerate(entries):
            at.setdefault(e, {}).setdefault(a, np.full(len(entries), NONE, dtype=np.int64))[k] = 0
        for i in range(min((e for _, e in entries), default=stop), stop):
            for a, row in at.get(i, {}).items():
                before = "" if a == START else s[a:i]
                for e in self.ends(s, i):
                    if self.follows(before, s[i:e]):
                        to = at.setdefault(e, {})
                        to[i] = np.maximum(to[i], row) if i in to else row
        return at

    def solve(self, s: str, entry: tuple[int, int] = (START, 0), leave: tuple[int, int] | None = None) -> bytes:
        """The ids of the pieces after entry up to leave, both (begin, end); without leave, to the end of s."""
        stop = len(s) if leave is None else leave[1]
        if entry[1] >= stop:
            return b""
        at = self.forward(s, [entry], stop if leave is None else leave[0] + 1)
        out: list[int] = []
        e = stop
        a = next(iter(at[e])) if leave is None else leave[0]
        while True:
            p = self.pieces.get(s[a:e])
            out += [p[0]] if p else [self.byte_ids[x] for x in reversed(s[a:e].encode("utf-8", "surrogatepass"))]
            if a <= entry[1]:
                break
            # of the pieces that end where this one begins, the one that it fits to
            a, e = next(b for b in at[a] if self.follows("" if b == START else s[b:a], s[a:e])), a
        return np.array(out[::-1], dtype=np.int32).tobytes()

    def stretch(self, s: str) -> bytes:
        """Ids of a stretch that begins and ends where no piece can cross."""
        x = self.ids_of.get(s)
        if x is not None:
            return x
        return self.solve(s) if len(s) <= CHUNK else self._long(s)

    def _long(self, s: str) -> bytes:
        parts = chunks(s, self.width)
        states = boundary_states([self.matrix(*p) for p in parts])
        return b"".join(self.trace(*p, i, j) for p, (i, j) in zip(parts, states, strict=True))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        cut = [STRETCH.findall(" " + t) if t else [] for t in texts]
        self.prepare(set().union(*cut))
        out = []
        for c in cut:
            try:
                out.append(b"".join(map(self.ids_of.__getitem__, c)))
            except KeyError:  # a stretch too long to be remembered
                out.append(b"".join([self.stretch(x) for x in c]))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def states(self, s: str, border: int) -> list[tuple[int, int]]:
        """(begin, end) of the pieces that begin before a border of s and end at or after it."""
        return [(a, e) for a in range(max(0, border - self.width), border) for e in self.ends(s, a) if e >= border]

    def cuts(self, s: str, left: int, right: int) -> tuple[int, int] | None:
        """The first and the last place inside a chunk that no piece can cross, both beyond what reaches in."""
        low = left + (self.width if left else 1)
        first = HARD.search(s, low, right)
        if not first:
            return None
        last = max(s.rfind("\n", low - 1, right - 1) + 1, s.rfind("\n", low, right))
        k = s.rfind(" ", low, right)
        while k >= low:
            if s[k - 1] != " ":
                last = max(last, k)
                break
            k = s.rfind(" ", low, k)
        return first.start(), max(last, first.start())

    def matrix(self, s: str, left: int, n: int) -> np.ndarray:
        """(states at begin, states at end) of a chunk of n characters from place left of s; around them stands what pieces may reach."""
        right = left + n
        entries = self.states(s, left) if left else [(START, 0)]
        exits = self.states(s, right)
        c = self.cuts(s, left, right)
        if c is None:
            return self._between(s, entries, right, exits)
        at = self.forward(s, entries, c[0]).get(c[0], {})
        head = np.max([np.full(len(entries), NONE, dtype=np.int64), *at.values()], axis=0)
        tail = self._between(s[c[1] :], [(START, 0)], right - c[1], [(a - c[1], e - c[1]) if a >= c[1] else None for a, e in exits])
        return plus(head[:, None], tail)

    def _between(self, s: str, entries: list[tuple[int, int]], right: int, exits: list[tuple[int, int] | None]) -> np.ndarray:
        at = self.forward(s, entries, right)
        out = np.full((len(entries), len(exits)), NONE, dtype=np.int64)
        for j, x in enumerate(exits):
            row = at.get(x[1], {}).get(x[0]) if x else None
            if row is not None:
                out[:, j] = row
        return out

    def trace(self, s: str, left: int, n: int, i: int, j: int) -> bytes:
        """The ids of a chunk after state i at its begin, up to and with state j at its end."""
        right = left + n
        entry = self.states(s, left)[i] if left else (START, 0)
        leave = self.states(s, right)[j]
        c = self.cuts(s, left, right)
        if c is None:
            return self.solve(s, entry, leave)
        inner = STRETCH.findall(s[c[0] : c[1]])
        self.prepare(set(inner))
        mid = [self.stretch(x) for x in inner]
        return b"".join([self.solve(s[: c[0]], entry), *mid, self.solve(s[c[1] :], (START, 0), (leave[0] - c[1], leave[1] - c[1]))])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def chunks(s: str, width: int, size: int = 0) -> list[tuple[str, int, int]]:
    """(chunk with what stands around it, where it begins in that, characters that are its own); none is shorter than two pieces."""
    size = max(size or CHUNK, 2 * width)
    starts = [k for k in range(0, len(s), size) if k == 0 or len(s) - k >= 2 * width]
    ends = [*starts[1:], len(s)]
    return [(s[max(0, k - width) : e + width], min(k, width), e - k) for k, e in zip(starts, ends, strict=True)]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    if not a.shape[1]:
        return np.full((a.shape[0], b.shape[1]), NONE, dtype=np.int64)
    x = a[:, :, None] + b[None]
    return np.where((a[:, :, None] > NONE) & (b[None] > NONE), x, NONE).max(1)


def product(mats: list[np.ndarray]) -> np.ndarray:
    out = mats[0]
    for m in mats[1:]:
        out = plus(out, m)
    return out


def boundary_states(mats: list[np.ndarray], entry: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the best path from entry to leave; the least state on ties.

    Without leave, to the best state at the end.
    """
    row = np.full((1, mats[0].shape[0]), NONE, dtype=np.int64)
    row[0, entry] = 0
    rows = [row]
    for m in mats:
        rows.append(plus(rows[-1], m))
    j, out = int(rows[-1][0].argmax()) if leave is None else leave, []
    for k in range(len(mats) - 1, -1, -1):
        col = mats[k][:, j]
        i = int(np.where((rows[k][0] > NONE) & (col > NONE), rows[k][0] + col, NONE).argmax())
        out.append((i, j))
        j = i
    return out[::-1]


def pack(m: np.ndarray) -> bytes:
    return np.int32(m.shape[0]).tobytes() + m.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64, offset=4).reshape(int(np.frombuffer(b, dtype=np.int32, count=1)[0]), -1)


def _lists(rows: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(r) // 4 for r in rows), np.int32, len(rows))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


class _Worker:
    """Holds the vocabulary of a Python worker; ships as the broadcast alone."""

    def __init__(self, handle):
        self.handle, self.made = handle, None

    def __getstate__(self):
        return {"handle": self.handle, "made": None}

    def __call__(self) -> Pieces:
        if self.made is None:
            self.made = Pieces(self.handle.value)
        return self.made


def _giants(docs: DataFrame, worker: _Worker, fan: int = FAN, size: int = 0) -> DataFrame:
    """(doc_id, h, ids) of distinct giant texts, chunk by chunk."""
    key = "doc_id bigint, h bigint"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = worker().width
        for b in batches:
            for one in slices(b):
                for d, h, t in zip(*(c.to_pylist() for c in one.columns), strict=True):
                    parts = chunks(" " + t, w, size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(parts), pa.int64()), pa.array([h] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array([p for p, _, _ in parts]), pa.array([x for _, x, _ in parts], pa.int32()), pa.array([n for _, _, n in parts], pa.int32())],
                        names=["doc_id", "h", "k", "part", "lead", "n"],
                    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [pack(worker().matrix(p, x, n)) for p, x, n in zip(*(b.column(c).to_pylist() for c in ("part", "lead", "n")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("k"), pa.array(m, pa.binary())], names=["doc_id", "h", "k", "m"])

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        m = pack(product([unpack(x) for x in t.column("m").to_pylist()]))
        return pa.table({"doc_id": t.column("doc_id")[:1], "h": t.column("h")[:1], "k": pa.array([t.column("k")[0].as_py() // fan], pa.int64()), "m": pa.array([m], pa.binary())})

    def read_off(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        s = boundary_states([unpack(x) for x in t.column("m").to_pylist()], t.column("i")[0].as_py(), t.column("j")[0].as_py())
        return pa.table({"doc_id": t.column("doc_id"), "h": t.column("h"), "k": t.column("k"), "i": pa.array([i for i, _ in s], pa.int32()), "j": pa.array([j for _, j in s], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [worker().trace(*x) for x in zip(*(b.column(c).to_pylist() for c in ("part", "lead", "n", "i", "j")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("k"), _lists(ids)], names=["doc_id", "h", "k", "ids"])

    def beside(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
        """Rows of a with the i and j of the rows of b whose k is `at`."""
        s = b.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("k").alias("k2"), "i", "j")
        return a.join(s, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.expr(at) == F.col("k2"))).drop("d2", "h2", "k2")

    parts = docs.select("doc_id", "h", "text").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    parts = cut(parts.mapInArrow(split, f"{key}, k bigint, part string, lead int, n int").repartition("doc_id", "h", "k"))
    # up the tree: the matrices of so many neighbours become one, until a document has one group
    levels = [cut(parts.mapInArrow(work, f"{key}, k bigint, m binary"))]
    most = levels[0].agg(F.max("k")).first()[0] or 0
    while most >= fan:
        levels.append(cut(levels[-1].groupBy("doc_id", "h", F.expr(f"k div {fan}")).applyInArrow(lambda t: combine(t), f"{key}, k bigint, m binary")))
        most //= fan
    # and down: the path's states at the ends of a group give those inside it
    states = None
    for level in reversed(levels):
        told = level.withColumn("i", F.lit(0)).withColumn("j", F.lit(None).cast("int")) if states is None else beside(level, states, f"k div {fan}")
        states = told.groupBy("doc_id", "h", F.expr(f"k div {fan}")).applyInArrow(lambda t: read_off(t), f"{key}, k bigint, i int, j int")
    traced = beside(parts, states, "k").select("doc_id", "h", "k", "part", "lead", "n", "i", "j").mapInArrow(trace, f"{key}, k bigint, ids array<int>")
    g = traced.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    return g.select("doc_id", "h", F.flatten(F.col("p.ids")).alias("ids"))


def encoded(docs: DataFrame, model: bytes, giant: int = GIANT, fan: int = FAN, size: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, round_trip) for each row of docs (doc_id, text).

    ids_sha256 is of the ids as little-endian 32-bit integers; round_trip says that they decode to the text.
    NULL and empty texts have no ids and decode to the empty text. Repeated rows keep one row each.
    """
    worker = _Worker(docs.sparkSession.sparkContext.broadcast(model))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, round_trip boolean"

    def rows(doc_ids: pa.Array, texts: list[str | None], packed: list[bytes]) -> pa.RecordBatch:
        p = worker()
        ok = [p.decode(np.frombuffer(x, dtype=np.int32).tolist()) == (t or "") for x, t in zip(packed, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array([len(x) // 4 for x in packed], pa.int64()), _lists(packed), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array(ok, pa.bool_())],
            names=["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip"],
        )

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, rows=500):
                t = s.column(1).to_pylist()
                yield rows(s.column(0), t, worker().encode_many(t))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                packed = [np.array(x or [], dtype=np.int32).tobytes() for x in s.column(2).to_pylist()]
                yield rows(s.column(0), s.column(1).to_pylist(), packed)

    short = d.filter(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(direct, schema)
    long = d.filter(F.length("text") > giant).withColumn("h", F.xxhash64("text"))
    ids = _giants(long, worker, fan, size).withColumnsRenamed({"doc_id": "d2", "h": "h2"})
    told = long.join(ids, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select("doc_id", "text", "ids")
    return short.unionByName(told.mapInArrow(check, schema))


def decoded(tokens: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); NULL ids give an empty text."""
    worker = _Worker(tokens.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([worker().decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def op9_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return encoded(documents(spark, sf_dir), model_bytes(model_path))
