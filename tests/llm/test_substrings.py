"""Operator 7 against a brute-force set of windows."""

import random

import brute

from tidewater.llm import substrings
from tidewater.llm.common import documents


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    want = brute.windows_removed(docs)
    assert result(substrings.op7_substrings(spark, sf)) == want
    assert sum(x[1] for x in want.values()) > 0


def test_hard_and_odd(spark):
    rng = random.Random(3)
    shared = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(4)]
    docs = [(i, " ".join(rng.choice(shared)[rng.randrange(40) :] for _ in range(rng.randrange(1, 5)))) for i in range(0, 120, 2)]
    docs += [(201, None), (202, ""), (203, "x " * 60), (204, "x " * 19), (205, "x " * 19), (1, "x " * 21), (206, docs[0][1]), (207, "é ß q " * 30), (208, "\x0bé ß q\x0c" * 30), (209, " ".join(map(str, range(30000)))), (210, " ".join(map(str, range(10, 30000))))]
    df = spark.createDataFrame([(a, b, "c", "s") for a, b in docs], "doc_id bigint, text string, copy string, seeds string")
    assert result(substrings.removed(df)) == brute.windows_removed(docs)
    twice = substrings.removed(spark.createDataFrame([(5, "a b " * 15), (5, "a b " * 15), (None, "a b " * 15)], "doc_id bigint, text string"))
    assert sorted((str(r.doc_id), r.n_removed) for r in twice.collect())[-1] == ("None", 30)
    assert substrings.removed(df.limit(0)).count() == 0
