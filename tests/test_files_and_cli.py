"""Array files in parts, the remaining sinks, the command line and its report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import cli
from tidewater.operators import graph, harness, ivf, paging
from tidewater.operators import vectors as vec
from tidewater.sources import benchlog, binary


def test_parts_are_the_array(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("x")).repartition(5)
    assert binary.write_bin_parts(df, str(tmp_path / "a"), "x", "<u4", "pos", 4) == 1000
    assert len(list((tmp_path / "a").iterdir())) == 4
    got = binary.read_bin(spark, str(tmp_path / "a"), "<u4", 1000).orderBy("pos").collect()
    assert [r.value for r in got] == [3 * i for i in range(1000)]
    assert binary.write_bin_parts(df.limit(0), str(tmp_path / "b"), "x", "<u4", "pos", 4) == 0


def test_index_sinks(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    c = vec.first_vectors(v, 3)
    index = ivf.build_index(v, c)
    binary.write_ivf_bin(index, c, ivf.cluster_offsets(ivf.cluster_sizes(index, c), 3), str(tmp_path / "bin"))
    assert np.fromfile(tmp_path / "bin/cluster_offsets.bin", "<i4").tolist() == [0, 10, 20, 30]
    assert np.fromfile(tmp_path / "bin/vector_indices.bin", "<i4").tolist() == [*range(0, 30, 3), *range(1, 30, 3), *range(2, 30, 3)]
    assert np.fromfile(tmp_path / "bin/raw_vectors.bin", "<f4").reshape(-1, 2)[:, 0].tolist() == [0.0] * 10 + [1.0] * 10 + [2.0] * 10
    assert np.fromfile(tmp_path / "bin/centroids.bin", "<f4").tolist() == [0.0, 1.0, 1.0, 1.0, 2.0, 1.0]
    binary.write_ivf(index, str(tmp_path / "ivf"))
    back = spark.read.parquet(str(tmp_path / "ivf"))
    assert paging.same_rows(back.select("cluster_id", "vec_id"), index.select(F.col("cluster_id").cast("int"), "vec_id"))


def test_edge_and_log_sinks(spark, tmp_path):
    e = graph.symmetrize(spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint"))
    binary.write_csr(e, str(tmp_path / "csr"))
    assert paging.same_rows(spark.read.parquet(str(tmp_path / "csr")), e)
    rows = [("Target_T", 1, 32, 100, 12.5, None, None, "REF"), ("BaM", 1, 32, 100, 15.25, 4000, 120, "PASS")]
    lines = harness.report(rows, harness.ANN_REPORT).split("\n")
    assert lines[0].startswith("Method     | WPQ  | Threads/Q") and len({len(x) for x in lines}) == 1
    parsed = benchlog.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), benchlog.ANN_COLUMNS)
    assert [tuple(r) for r in parsed.collect()] == rows
    benchlog.write_bench_csv(parsed, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).select("Method", "DRAM_Misses").collect())) == [("BaM", "120"), ("Target_T", None)]


def test_bounded_tiers_and_pins(spark):
    t = spark.createDataFrame([(i, 0, 0, i, p * 1024) for i, p in enumerate([1, 2, 3, 4, 1, 2, 5, 1, 2, 3, 4, 5])], "seq bigint, launch bigint, block bigint, thread bigint, index bigint")
    r = paging.bounded_tier_hits(t, 3, 2, "launch").first()
    assert tuple(r) == (12, 0, 0, 3, 9)
    # with T2 every page but the first touch is held there
    assert tuple(paging.bounded_tier_hits(t, 3, 3, "launch").first()) == (12, 0, 7, 0, 5)
    e = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 33, 1), (0, 2, 1, -1), (0, 3, 1, 1), (0, 4, 1, -2), (0, 5, 33, 1), (0, 6, 1, -1), (1, 0, 1, 1)], "block bigint, seq bigint, page bigint, count bigint")
    assert sorted(map(tuple, paging.pinned_entries(e).collect())) == [(0, 1, 1, 2, 1, 1, 1), (1, 1, 0, 1, 0, 0, 1)]


def test_invalid_probes_are_passed_over(spark):
    v = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "vec_id bigint, embedding array<float>")
    c = spark.createDataFrame([(0, [0.0]), (-1, [0.0]), (1, [10.0])], "cluster_id bigint, centroid array<double>")
    q = spark.createDataFrame([(0, [1.0])], "query_id bigint, embedding array<float>")
    index = ivf.build_index(v, c.filter("cluster_id >= 0"))
    assert [r.vec_id for r in ivf.search(index, c, q, 2).collect()] == [0]


def test_command_line(spark, tmp_path, capsys):
    g = f"file://{tmp_path}/g"
    assert cli.main(["gen-bfs", "--scale", "7", "--target_degree", "8", "--out_dir", g], spark) == 0
    assert cli.main(["bfs", "--data_dir", g, "--cache_perc", "0.5"], spark) == 0
    out = capsys.readouterr().out
    assert "128 nodes" in out and out.rstrip().endswith("PASS") and "Target_T" in out
    k = f"file://{tmp_path}/k"
    assert cli.main(["gen-knn", "--scale", "8", "--clusters", "12", "--dim", "16", "--iterations", "2", "--data_dir", k], spark) == 0
    assert cli.main(["ann", "--data_dir", k, "--dim", "16", "--queries", "9", "--cache", "0.5", "--strange", "x"], spark) == 0
    out = capsys.readouterr().out
    assert "256 vectors" in out and out.rstrip().endswith("PASS") and "VRAM Hits" in out


@pytest.mark.parametrize("bad", [["bfs", "--strange", "1"], ["bfs", "--tlb", "4"], ["bfs", "--cache_perc", "0"], ["ann", "--wpq", "33"], ["walk"], []])
def test_wrong_options(spark, bad, capsys):
    assert cli.main(bad, spark) == 1 and capsys.readouterr().err
