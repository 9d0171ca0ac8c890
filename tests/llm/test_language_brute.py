"""Operator 4 against a naive greedy parse, and its size with many letters and languages."""

import math
import pickle
import random

import numpy as np

from tidewater.llm import language
from tidewater.llm.common import table


def symbols(text, known):
    out = []
    for c in text.lower():
        s = "?" if c.isalpha() and c not in known else c if c.isalpha() else " "
        if s != " " or not out or out[-1] != " ":
            out.append(s)
    return out


def phrases(text, train, known, lane):
    """Longest matches in a training text, one after another, anew at each lane."""
    s, n = symbols(text, known), 0
    for k in range(0, len(s), lane):
        part, i = s[k : k + lane], 0
        while i < len(part):
            j = i
            while j < len(part) and part[j] != "?" and "".join(part[i : j + 1]) in train:
                j += 1
            n, i = n + 1, max(j, i + 1)
    return n, len(s)


def naive(samples, text, lane=language.LANE):
    known = {c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()}
    best = []
    for lang in sorted(samples):
        train = "".join(symbols("\n".join(samples[lang]), known))[: language.TRAIN_CHARS]
        p, n = phrases(text, train, known, lane)
        best.append(p * math.log2(len(train) + 2) / max(n, 1))
    return sorted(samples)[int(np.argmin(best))], best


def test_query_equals_a_naive_parse(spark, sf, monkeypatch):
    """Every row of the table; the training text is cut short, so that the naive parse ends."""
    monkeypatch.setattr(language, "TRAIN_CHARS", 1500)
    seen = {}
    learn = language.learn
    monkeypatch.setattr(language, "learn", lambda samples, most: seen.update(samples) or learn(samples, most))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op4_language(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 3000]
    assert len(seen) > 1 and len(short) > 50
    for r in short:
        if any(c.isalpha() for c in r.text or ""):
            lang, h = naive(seen, r.text)
            a, b = sorted(h)[:2]
            assert got[r.doc_id][0] == lang and math.isclose(got[r.doc_id][1], b / (a + b))
        else:
            assert got[r.doc_id] == ("und", 0.0)


def test_many_letters_take_little_memory():
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(rng.choice(letters) for _ in range(40_000))
    m = language.learn({"a": [text], "b": ["the words of another language " * 900]})
    assert all(t.nbytes() < 50 << 20 for t in m.tables) and len(pickle.dumps(m)) < 60 << 20
    assert language.predict(m, [text[700:750] + text[9000:9050], "words of the other language"])[0] == ["a", "b"]


def test_many_languages_share_the_bound(spark):
    rng = random.Random(6)
    rows = [(i * 3 + j, " ".join(chr(0x100 + 5 * i + rng.randrange(5)) * 4 for _ in range(400)), f"l{i:02}") for i in range(40) for j in range(3)]
    m = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(m.langs) > 25 and sum(t.states for t in m.tables) <= 2 * language.ALL_CHARS + 80
