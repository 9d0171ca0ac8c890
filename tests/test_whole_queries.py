"""Searches over every vector whose id is divisible by 100."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import distance
from tidewater.operators import vectors as vec
from tidewater.plans import catalog
from tidewater.plans.catalog import REGISTRY


def test_every_hundredth_vector_is_asked(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.query_id: r.vec_id for r in REGISTRY["knn_topk_exact_whole"](spark, str(tmp_path)).filter("rank = 1").collect()}
    d = ((x[::100, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    d[np.arange(30), np.arange(30) * 100] = np.inf
    assert got == {100 * i: int(b) for i, b in enumerate(d.argmin(1))}
    assert REGISTRY["ivf_search_recall_whole"](spark, str(tmp_path)).first().queries == 30
    assert REGISTRY["query_sampler_whole"](spark, str(tmp_path)).count() == catalog.SAMPLED


@pytest.mark.parametrize("bound", [256 << 20, 1 << 12])
def test_blocks_of_queries(spark, monkeypatch, bound):
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    q = v.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(distance, "MAX_BROADCAST_BYTES", bound)
    monkeypatch.setattr(distance, "QUERY_BLOCK", 7)
    assert {r.query_id: (r.vec_id, r.dist) for r in vec.brute_force_knn(v, q, exclude_self=True).collect()} == {i: (max(i - 1, 0) if i else 1, 1.0) for i in range(60)}


def test_sums_in_tasks_equal_sums_on_the_driver(spark, monkeypatch):
    v = spark.range(200).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), (F.col("id") % 3).cast("float")).alias("embedding"))
    means = lambda: {r.cluster_id: r.centroid for r in vec.kmeans(v, 4, 3).collect()}
    want = means()
    monkeypatch.setattr(vec, "SUMS_BYTES", 0)
    assert means() == want
