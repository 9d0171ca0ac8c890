"""Further columns with any name, and queries against plain versions of themselves."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import decontaminate, quality, secrets, sharding, simhash
from tidewater.llm.common import documents, table

NAMES = ["_t", "_r", "_id", "_h", "_d", "h", "d", "o", "z", "r", "row", "w", "c", "known", "term", "pos", "Start", "a.b", "n_words", "fp", "component_id", "ids", "score", "item", "block"]
TEXT = "the first of many words in a text that is long enough to be read "


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, TEXT * 3), (2, TEXT * 3), (2, TEXT * 3), (3, None), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "another text"), (5, "")]
    return spark.createDataFrame([(*r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(rows)], ", ".join(["doc_id bigint, text string", *(f"`{n}` string" for n in NAMES)]))


def values(df):
    return {tuple(r)[2:] for r in df.collect()}


def test_columns_keep_their_values(spark, clashing):
    whole = values(clashing)
    one = simhash.keep_one(clashing)
    assert one.columns == clashing.columns and values(one) <= whole and one.count() == 4
    items = spark.createDataFrame([("x", "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id string, text string")
    left = decontaminate.drop_contaminated(clashing, items)
    assert left.columns == clashing.columns and values(left) == {v for v in whole if not v[0].endswith("4")} and left.count() == 6
    m = quality.fit(clashing, spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int"))
    assert values(quality.keep_good(clashing, m)) <= whole
    assert values(secrets.mask_documents(clashing)) == whole


def test_stages_keep_their_values(spark, clashing, tmp_path):
    for t, cols, rows in (("labels", "doc_id bigint, quality int, toxic int", [(1, 1, 0), (2, 1, 0), (4, 1, 0)]), ("benchmark", "item_id bigint, text string", [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")])):
        spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns and values(out) <= values(clashing)
    # an empty benchmark drops nothing
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.keep_clean(spark, clashing, f"{tmp_path}/none").count() == clashing.count()


def test_tokens_are_words_between_white_space(spark):
    texts = [None, "", "\n", " a b", "\n\ta b\n", "a", "a\x0bb\x0cc", "  "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.tokens for r in sharding.measured(d).collect()} == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 1, 6: 3, 7: 0}


def test_groups_that_fit_share_a_shard(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = sharding.op1_sharding(spark, sf).collect()
    place, load = defaultdict(set), Counter()
    for r in rows:
        place[docs[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
    total = sum(load.values())
    group = Counter()
    for t in docs.values():
        group[t] += len((t or "").encode()) + 16
    assert all(len(place[t]) == 1 for t, size in group.items() if size * sharding.SHARDS <= total and t in place)
    assert len(load) == sharding.SHARDS and max(load.values()) < 1.1 * min(load.values())


def test_packing_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(sharding, "_settle", lambda x, out, left: out)
    rng = np.random.default_rng(3)
    items = rng.integers(1, 40, (120, 3)).astype(float)
    items[10:30] = items[10]  # ties
    weighted = [[w * v / t for v, t, w in zip(row, items.sum(0), sharding.WEIGHTS)] for row in items.tolist()]
    left = [[sum(col) / 7 for col in zip(*weighted)] for _ in range(7)]
    want = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -max(weighted[i])):
        dots = [sum(a * b for a, b in zip(s, weighted[i])) for s in left]
        best = max(range(7), key=lambda s: (round(dots[s], 12), -s))
        want[i] = best
        left[best] = [a - b for a, b in zip(left[best], weighted[i])]
    assert sharding.pack(items, 7).tolist() == want


def test_large_items_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    d = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one text' ELSE concat('text ', id) END AS text")
    by = defaultdict(list)
    for r in sharding.shard(d, 2).collect():
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 3000


def test_added_secrets_at_every_place():
    body = "Zz9" * 10
    good = "npm_" + body + secrets.crc62(body)
    jwt = "eyJhbGciOiJub25lIn0.eyJhIjoxfQ.c2ln"
    texts = [f"x{good}", good + "A", f"{good}.{good}", f"gho_{good}", jwt, f"ey{jwt} eyJ.eyJ.x", f"{jwt}.{jwt}", f"token={jwt} ghp_{body}000000", "é" + good + " " + jwt]
    for text in texts:
        want, free = [], {3: 0, 4: 0}
        for s, (k, pattern) in itertools.product(range(len(text)), ((3, secrets.CRC62), (4, secrets.JWT))):
            m = pattern.match(text, s)
            if m and s >= free[k]:
                free[k] = m.end()
                if (secrets.crc62(m[1]) == m[2]) if k == 3 else all(secrets._json_part(p) for p in m.groups()):
                    want.append((s, k, m.end()))
        assert [x for x in secrets.scan(text, secrets.automaton()) if x[1] > 2] == sorted(want)


def test_quality_query_equals_the_sum_over_pairs(spark, sf):
    docs = documents(spark, sf)
    m = quality.fit(docs, table(spark, sf, "labels"))
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    rows = docs.collect()
    assert sorted(got) == sorted(r.doc_id for r in rows)
    checked = 0
    for r in rows:
        idx, val = quality.features(r.text, {})
        if len(idx) > 400:
            continue
        x, v = np.array(val), m.v[idx]
        z = m.w0 + (m.w[idx] * x).sum() + np.triu((v @ v.T) * np.outer(x, x), 1).sum()
        p = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert math.isclose(got[r.doc_id].score, p, rel_tol=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        checked += 1
    assert checked > 50
