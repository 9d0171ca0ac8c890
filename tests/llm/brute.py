"""Plain-Python versions of the operators, for comparison on small tables."""

import collections
import hashlib
import re

import xxhash


def connected(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def simhash_rows(docs):
    fps = [simhash(t) for _, t in docs]
    edges = [(i, j) for i in range(len(docs)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    comp = connected(range(len(docs)), edges)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[comp[i]] = min(d, low.get(comp[i], d))
    return [(d, f"{f:016x}", low.get(comp[i])) for i, ((d, _), f) in enumerate(zip(docs, fps))]


def base_secrets(text):
    text = text or ""
    key = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    a = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    s = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(s.encode()).hexdigest()


def windows_removed(docs, n=20):
    """docs sorted by id -> {id: (n_words, n_removed, sha)}"""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words):
        w, dead = words[d], [False] * len(words[d])
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                dead[i : i + n] = [True] * n
            seen.add(k)
        out[d] = (len(w), sum(dead), hashlib.sha256(" ".join(x for x, z in zip(w, dead) if not z).encode()).hexdigest())
    return out


def contamination(docs, items, n=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in wins:
                    hit |= set(range(k, k + m))
                    ids |= wins[x]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
