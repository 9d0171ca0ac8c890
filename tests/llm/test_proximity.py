"""Benchmark passages with a word in ten inserted, dropped or changed."""

import pytest

from tidewater.llm import decontaminate, register
from tidewater.llm.common import documents, table

PASSAGE = [f"q{i}" for i in range(40)]


def changed(kind):
    out = []
    for i, w in enumerate(PASSAGE):
        if i % (9 if kind == "inserted" else 10) != 5:
            out.append(w)
        elif kind == "inserted":
            out += ["new", w]
        elif kind == "changed":
            out.append("other")
    return " ".join(out)


@pytest.mark.parametrize("kind", ["inserted", "dropped", "changed"])
@pytest.mark.parametrize("elsewhere", [True, False])
def test_one_word_in_ten(spark, kind, elsewhere):
    rows = [(1, "a b c " + changed(kind) + " x y z"), (2, "nothing of it q1 q2 q3 far q9")] + ([(3, "q5 q15 q25 q35")] if elsewhere else [])
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    w = decontaminate.windows(spark.createDataFrame([(7, " ".join(PASSAGE))], "item_id bigint, text string"))
    assert decontaminate.phrase_matches(d, w).count() == 0
    assert {r.doc_id for r in decontaminate.proximity_matches(d, w).collect()} == {1}


def test_every_start(spark):
    words = " ".join(PASSAGE[:10])
    d = spark.createDataFrame([(1, f"{words} {words} filler {words}")], "doc_id bigint, text string")
    w = decontaminate.windows(spark.createDataFrame([(7, words)], "item_id bigint, text string"))
    assert sorted(r.start for r in decontaminate.proximity_matches(d, w).collect()) == [0, 10, 21]


def test_other_words_decide(spark):
    d = spark.createDataFrame([(1, "q0 q1 q2 a b c d e f g"), (2, "q3 q4 q5 q6 q7 q8 q9 " * 9)], "doc_id bigint, text string")
    w = decontaminate.windows(spark.createDataFrame([(7, " ".join(PASSAGE[:10]))], "item_id bigint, text string"))
    assert decontaminate.proximity_matches(d, w).count() == 0


def test_query_holds_every_exact_match(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", "text")
    exact = {r.doc_id for r in decontaminate.contamination(documents(spark, sf), items).filter("contaminated").collect()}
    assert exact and exact <= {r.doc_id for r in register.queries()["op2_proximity"](spark, sf).collect()}
