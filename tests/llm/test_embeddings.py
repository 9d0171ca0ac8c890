"""Operator 8 against all pairs in double precision."""

import brute
import numpy as np

from tidewater.llm import embeddings


def all_pairs(rows):
    ids = [i for i, _ in rows]
    x = np.array([r for _, r in rows], dtype=float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = brute.connected(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    return {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, link.sum(1), strict=True)}


def test_clusters_and_recall(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] * (3 if i % 3 else 1) + 0.25 * rng.standard_normal(32)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    want = all_pairs(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    a, b = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert 0.98 * b <= a <= b
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.98 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, []), (2, [2.0, 0.1]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id bigint, embedding array<float>, key int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == sorted([("1", 1, "1", True), ("2", 1, "1", False), ("2", 1, "1", False), ("None", 0, "None", True), *((str(i), 0, str(i), True) for i in range(3, 10))])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.filter("vec_id = 3")).count() == 1
