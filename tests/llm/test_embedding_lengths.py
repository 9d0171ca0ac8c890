"""Vectors of every length are compared with those of their own."""

import numpy as np

from tidewater.llm import embeddings


def test_links_of_every_length(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for dim, n in ((8, 5), (16, 9), (32, 3), (1, 2)):
        x = abs(rng.normal(size=dim)) + 0.1
        for i in range(n):
            want[len(rows)] = (n - 1, len(rows) - i)
            rows.append((len(rows), [float(v) for v in x * (i + 1)]))
    r = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in r} == want
