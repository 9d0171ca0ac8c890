"""Beyond the counted bounds of broadcasts the same rows come out."""

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import decontaminate, embeddings, html, substrings
from tidewater.llm.common import slices


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_decontamination_by_shuffle(spark, sf, monkeypatch):
    want = rows(decontaminate.op2_decontaminate(spark, sf))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows(decontaminate.op2_decontaminate(spark, sf)) == want and any(r[5] for r in want)


def test_substrings_by_shuffle(spark, sf, monkeypatch):
    want = rows(substrings.op7_substrings(spark, sf))
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    assert rows(substrings.op7_substrings(spark, sf)) == want


def test_large_buckets_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, 12))
    v = spark.createDataFrame([(i, (centres[i % 3] + 0.1 * rng.standard_normal(12)).tolist()) for i in range(400)], "vec_id bigint, embedding array<double>")
    want = rows(embeddings.near_duplicates(v))
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert rows(embeddings.near_duplicates(v)) == want
    monkeypatch.setattr(embeddings, "BROADCAST_ROWS", -1)
    assert rows(embeddings.near_duplicates(v)) == want and sum(r[1] for r in want) > 1000


def test_templates_by_shuffle(spark, sf, monkeypatch):
    want = rows(html.op6_html(spark, sf))
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert rows(html.op6_html(spark, sf)) == want


@pytest.mark.parametrize("size", [1, 100, 1 << 30])
def test_slices_hold_every_row(size):
    b = pa.RecordBatch.from_pydict({"text": [None, "", "a" * 300, *("b" * i for i in range(50))]})
    got = [x for s in slices(b, size) for x in s.column(0).to_pylist()]
    assert got == b.column(0).to_pylist() and not list(slices(b.slice(0, 0), size))
