"""segment_sum over more edges than the 1,048,576 places of the gathers' array."""

from __future__ import annotations

import pytest

from tidewater.plans.catalog import REGISTRY

SIDE = 730


@pytest.mark.parametrize("name", ["segment_sum", "segment_sum_whole"])
def test_segments_beyond_the_array_of_the_gathers(spark, tmp_path, name):
    d = str(tmp_path)
    spark.range(SIDE).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(SIDE).selectExpr("id AS c_custkey").write.parquet(f"{d}/customer.parquet")
    spark.range(SIDE).selectExpr("id AS p_partkey").write.parquet(f"{d}/part.parquet")
    spark.range(SIDE * SIDE).selectExpr(f"id div {SIDE} AS l_orderkey", f"id % {SIDE} AS l_partkey", "50.0D AS l_quantity").write.parquet(f"{d}/lineitem.parquet")
    assert 2 * SIDE * SIDE > 1048576
    # every node has SIDE edges, so the one of rank r holds the places from r * SIDE on
    want = {node: SIDE * node * SIDE + SIDE * (SIDE - 1) // 2 for node in range(2 * SIDE)}
    assert {r.node: r.total for r in REGISTRY[name](spark, d).collect()} == want
