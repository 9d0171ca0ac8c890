"""Edge cases that the tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import generators as gen
from tidewater.operators import graph, harness, ivf, paging
from tidewater.operators import vectors as vec
from tidewater.sources import benchlog, binary
from tidewater.streaming.fifo import fifo_stream


def test_path_longer_than_100_levels(spark):
    e = graph.symmetrize(spark.range(150).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    d = {r.node: r.dist for r in graph.bfs(e, 0, max_levels=120).collect()}
    assert d == {i: i for i in range(121)}


def test_directed_and_disconnected(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src bigint, dst bigint")
    assert {r.node: r.dist for r in graph.bfs(e, 0, symmetric=False).collect()} == {0: 0, 1: 1, 2: 2}


def test_nearest_rank_quartiles(spark):
    d = spark.range(1, 9).select(F.col("id").alias("node"), F.col("id").alias("degree"))
    r = graph.degree_stats(d).first()
    assert (r.q1, r.median, r.q3, r.n, r.total) == (3, 5, 7, 8, 36)


def test_halves_quartiles_and_trailing_empty_clusters(spark):
    s = spark.range(1, 9).select(F.col("id").alias("cluster_id"), F.col("id").alias("size"))
    r = ivf.cluster_stats(s).first()
    assert (r.q1, r.median, r.q3) == (2.5, 4.5, 6.5)
    s = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 0)], "cluster_id bigint, size bigint")
    assert [(r.cluster_id, r.offset, r["size"]) for r in ivf.cluster_offsets(s, 4).orderBy("cluster_id").collect()] == [(0, 0, 2), (1, 2, 0), (2, 2, 3), (3, 5, 0), (4, 5, 0)]


def test_ties_and_nan(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 0.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id bigint, embedding array<float>")
    assert [(r.vec_id, r.dist) for r in vec.brute_force_knn(v, q, 5).orderBy("rank").collect()] == [(0, 1.0), (1, 1.0)]
    with pytest.raises(ValueError):
        vec.kmeans(v, 4)
    with pytest.raises(ValueError):
        vec.sample_queries(v, 4)


def test_empty_cluster_becomes_zero(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 0, 1, 1])], "vec_id bigint, embedding array<float>")
    assert [r.centroid for r in vec.kmeans(v, 2, 1, 1.0).orderBy("cluster_id").collect()] == [[0.5], [0.0]]


def test_search_without_candidates(spark):
    v = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "vec_id bigint, embedding array<float>")
    c = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "cluster_id bigint, centroid array<double>")
    q = spark.createDataFrame([(0, 0, [0.0])], "query_id bigint, vec_id bigint, embedding array<float>")
    r = ivf.search(ivf.build_index(v, c), c, q, 1, exclude_self=True, outer=True).collect()
    assert [(x.vec_id, x.pos, x.dist) for x in r] == [(-1, -1, float("inf"))]


def test_fifo_anomaly(spark):
    t = spark.createDataFrame([(0, i, p * 1024) for i, p in enumerate([1, 2, 3, 4, 1, 2, 5, 1, 2, 3, 4, 5])], "block bigint, seq bigint, index bigint")
    assert {r.slots: (r.hits, r.misses) for r in paging.fifo_simulate(t, [3, 4]).collect()} == {3: (3, 9), 4: (2, 10)}


def test_fifo_stream(spark, tmp_path):
    rows = [(0, i, p * 1024) for i, p in enumerate([1, 2, 3, 4, 1, 2, 5, 1, 2, 3, 4, 5])]
    for k in range(2):
        spark.createDataFrame(rows[k * 6 : k * 6 + 6], "block bigint, seq bigint, index bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("block bigint, seq bigint, index bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fifo_stream(s, 3).writeStream.outputMode("update").format("memory").queryName("fifo_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.sql("SELECT max(hits), max(misses) FROM fifo_out").first()
    assert r[0] + r[1] == 12


def test_golden_hash_values(spark):
    got = [r.value for r in gen.hash_elements(spark, 129).orderBy("t").collect()]
    assert got[:4] == pytest.approx([0.20733219385147095, 0.7907621264457703, 0.03044670820236206, 0.24925798177719116], abs=0)
    assert got[128] == pytest.approx(0.2700001001358032, abs=0)
    v = gen.hash_vectors(spark, 2).orderBy("vec_id").collect()
    assert v[0].embedding[:4] == got[:4] and v[1].embedding[0] == got[128]


def test_golden_shared_trace(spark):
    got = {r.seq: (r.page, r["index"]) for r in gen.warp_shared_trace(spark, 34, 4, 131072).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 32, 33)] == [(0, 0), (96689, 99009537), (62306, 63801346), (27923, 28593155), (0, 4), (124612, 127602688), (90229, 92394497)]


def test_sequential_trace_hits(spark):
    t = spark.range(4096).select(F.col("id").alias("seq"), F.lit(0).alias("block"), F.lit(0).alias("thread"), F.col("id").alias("index"))
    r = paging.tier_hits(t).first()
    assert (r.accesses, r.t1_hits, r.misses) == (4096, 4092, 4)


def test_binary_files(spark, tmp_path):
    p = str(tmp_path / "a.bin")
    np.arange(1000, dtype="<u4").tofile(p)
    assert binary.read_bin(spark, p, "<u4", 1000).agg(F.sum(F.abs(F.col("pos") - F.col("value")))).first()[0] == 0
    with pytest.raises(ValueError):
        binary.read_bin(spark, p, "<u4", 999)
    with pytest.raises(ValueError):
        binary.read_vectors_bin(spark, p, 7)


def test_graph_and_index_files(spark, tmp_path):
    e = graph.symmetrize(spark.createDataFrame([(0, 1), (1, 2), (2, 2), (0, 1)], "src bigint, dst bigint"))
    nodes = spark.range(4).toDF("node")
    binary.write_graph(graph.csr_offsets(e, nodes).withColumn("node", F.coalesce("node", F.lit(1 << 40))), graph.csr_edges(e), graph.graph_metadata(e, nodes), str(tmp_path))
    assert np.fromfile(tmp_path / "offsets.bin", "<u4").tolist() == [0, 1, 3, 4, 4]
    assert np.fromfile(tmp_path / "edges.bin", "<i4").tolist() == [1, 0, 2, 1]
    assert np.fromfile(tmp_path / "metadata.bin", "<i8").tolist() == [4, 4, 1, 2]
    sizes = spark.createDataFrame([(0, 2), (1, 3)], "cluster_id bigint, size bigint")
    binary.write_cluster_distribution(sizes, str(tmp_path / "csv"))
    assert sorted(map(tuple, binary.read_cluster_distribution(spark, str(tmp_path / "csv")).collect())) == [(0, 2), (1, 3)]


def test_bench_log_file(spark, tmp_path):
    (tmp_path / "log").write_text("x\nBaM | 32 | 1.5 | 10 | 1 | 2 | 3 | PASS\n")
    assert [tuple(r) for r in benchlog.read_bench_log(spark, str(tmp_path / "log"), "bfs").collect()] == [("BaM", 32, 1.5, 10, 1, 2, 3, "PASS")]


def test_parameters_and_sweep(spark):
    for bad in ({"tlb": 4}, {"wpq": 33}, {"cache_pages": 0}, {"cache_share": 1.5}, {"tpn": 33}):
        with pytest.raises(ValueError):
            harness.validate(**bad)
    harness.validate(3, 4, 10, 0.1, 64)
    assert paging.sizing(1025, 0.5) == (2, 1)
    t = spark.range(10)
    assert [r.status for r in harness.sweep(spark, "n", [1, 2], lambda v: spark.range(10).repartition(v), t).collect()] == ["PASS", "PASS"]


def test_graph_generators(spark):
    g = graph.symmetrize(gen.rmat_edges(spark, 8)).persist()
    assert g.filter("src = dst").isEmpty() and g.count() == g.join(g.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).count()
    u = gen.uniform_edges(spark, 10, 16)
    assert 8000 < u.count() <= 8192
    z = gen.zipf_trace(spark, 5000, 100)
    assert z.count() == 5000
    top = z.groupBy(F.floor(F.col("index") / 1024).alias("p")).count().orderBy(F.desc("count")).first()
    assert top.p == 0 and abs(top["count"] / 5000 - 1 / sum(1 / i for i in range(1, 101))) < 0.03
