"""The graph queries over all purchases, against plain Python."""

from collections import defaultdict

from pyspark.sql import functions as F

from tidewater.operators import graph
from tidewater.plans.catalog import REGISTRY
from tidewater.plans.oracles import FILTER, ORACLES
from tidewater.sources.tables import table


def test_whole_graph_holds_every_purchase(spark, sf):
    customer = {r.o_orderkey: r.o_custkey for r in table(spark, sf, "orders").select("o_orderkey", "o_custkey").collect()}
    near = defaultdict(set)
    for r in table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").collect():
        if r.l_orderkey in customer:
            u, v = 2 * customer[r.l_orderkey], 2 * r.l_partkey + 1
            near[u].add(v)
            near[v].add(u)
    assert {tuple(r) for r in REGISTRY["edges_undirected_whole"](spark, sf).collect()} == {(a, b) for a, x in near.items() for b in x}
    source = min(near, key=lambda x: (-len(near[x]), x))
    assert REGISTRY["max_degree_source_whole"](spark, sf).first()[0] == source
    dist, front = {source: 0}, [source]
    while front:
        new = {y for x in front for y in near[x]} - dist.keys()
        dist |= dict.fromkeys(new, dist[front[0]] + 1)
        front = list(new)
    assert {r.node: r.dist for r in REGISTRY["bfs_distances_whole"](spark, sf).collect()} == dist


def test_every_filtered_query_has_a_whole_one():
    cut = {n for n, sql in ORACLES.items() if FILTER in sql}
    assert len(cut) == 13 and all(FILTER not in ORACLES[f"{n}_whole"] and f"{n}_whole" in REGISTRY for n in cut)


def test_frontiers_by_shuffle_and_by_broadcast(spark, monkeypatch):
    e = graph.symmetrize(spark.range(60).select((F.col("id") % 20).alias("src"), ((F.col("id") * 7 + 3) % 31).alias("dst")))
    want = {r.node: r.dist for r in graph.bfs(e, 0).collect()}
    monkeypatch.setattr(graph, "SMALL_FRONTIER", -1)
    assert {r.node: r.dist for r in graph.bfs(e, 0, width=3).collect()} == want
