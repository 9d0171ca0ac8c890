"""Command line: generate graphs and vector indexes as files, search them, and report the results.

python -m tidewater.cli gen-bfs|gen-knn|bfs|ann [options]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import generators as gen
from .operators import graph, harness, ivf, paging
from .operators import vectors as vec
from .session import cut, local_session
from .sources import benchlog, binary

PROBES = 10
QUERIES = 100
TARGET, OWN = benchlog.ROW_MARKS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("gen-bfs", help="a random graph as CSR files")
    c.add_argument("--scale", type=int, default=20, help="2^N nodes")
    c.add_argument("--target_degree", type=int, default=16)
    c.add_argument("--graph_type", choices=("uniform", "rmat"), default="uniform")
    c.add_argument("--out_dir", default="./")
    c = sub.add_parser("gen-knn", help="hashed vectors, their clusters and inverted file")
    c.add_argument("--data_dir", default="./data")
    c.add_argument("--scale", type=int, default=20, help="2^N vectors")
    c.add_argument("--clusters", type=int, default=1024)
    c.add_argument("--dim", type=int, default=128)
    c.add_argument("--iterations", type=int, default=20)
    c = sub.add_parser("bfs", help="breadth-first search from the node of highest degree")
    c.add_argument("--cache_perc", type=float, default=1.0)
    c.add_argument("--tpn", type=int, default=32, help="threads a node")
    c.add_argument("--data_dir", default="./data/")
    c.add_argument("--tlb", type=int, default=3, help="tiers, 2 or 3")
    c = sub.add_parser("ann", help="nearest neighbours over the inverted file; unknown options are ignored")
    c.add_argument("--data_dir", default="../data")
    c.add_argument("--scale", type=int, default=20)
    c.add_argument("--cache", type=float, default=1.0)
    c.add_argument("--wpq", type=int, default=4, help="warps a query")
    c.add_argument("--tlb", type=int, default=3, help="tiers, 2 or 3")
    c.add_argument("--dim", type=int, default=128)
    c.add_argument("--queries", type=int, default=QUERIES)
    return p


def gen_bfs(spark: SparkSession, a: argparse.Namespace) -> str:
    e = gen.rmat_edges(spark, a.scale, a.target_degree) if a.graph_type == "rmat" else gen.uniform_edges(spark, a.scale, a.target_degree)
    e = cut(graph.symmetrize(e))
    nodes = spark.range(1 << a.scale).toDF("node")
    last = F.coalesce("node", F.lit((1 << 63) - 1))
    binary.write_graph(graph.csr_offsets(e, nodes).withColumn("node", last), graph.csr_edges(e), graph.graph_metadata(e, nodes), a.out_dir)
    s = graph.degree_stats(graph.degrees(e, nodes)).first()
    return f"{s.n} nodes, {s.total} edges, degree min {s.min}, q1 {s.q1}, median {s['median']}, q3 {s.q3}, max {s.max}, average {s.avg:.2f}"


def gen_knn(spark: SparkSession, a: argparse.Namespace) -> str:
    v = cut(gen.hash_vectors(spark, 1 << a.scale, a.dim))
    c = vec.kmeans(v, a.clusters, a.iterations)
    index = cut(ivf.build_index(v, c))
    sizes = cut(ivf.cluster_sizes(index, c))
    binary.write_ivf_bin(index, c, ivf.cluster_offsets(sizes, a.clusters), a.data_dir, parts=True)
    binary.write_cluster_distribution(sizes, f"{a.data_dir}/cluster_distribution.csv")
    s = ivf.cluster_stats(sizes).first()
    return f"{1 << a.scale} vectors, {a.clusters} clusters, sizes min {s.min}, q1 {s.q1}, median {s['median']}, q3 {s.q3}, max {s.max}, average {s.avg}, empty {s.empty}"


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """(edges, nodes, source) of the three graph files."""
    meta = [r.value for r in binary.read_bin(spark, f"{folder}/metadata.bin", "<i8", 4).orderBy("pos").collect()]
    offsets = binary.read_bin(spark, f"{folder}/offsets.bin", "<u4", meta[0] + 1).toDF("node", "o")
    ends = offsets.select((F.col("node") - 1).alias("node"), F.col("o").alias("e"))
    slots = offsets.join(ends, "node").filter("e > o").select(F.col("node").alias("src"), F.explode(F.expr("sequence(o, e - 1)")).alias("pos"))
    dst = binary.read_bin(spark, f"{folder}/edges.bin", "<i4", meta[1]).select("pos", F.col("value").cast("bigint").alias("dst"))
    return slots.join(dst, "pos").select("src", "dst"), offsets.filter(F.col("node") < meta[0]).select("node"), meta[2]


def read_index(spark: SparkSession, folder: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(index, centroids) of the four inverted-file arrays."""
    c = binary.read_vectors_bin(spark, f"{folder}/centroids.bin", dim).select(F.col("vec_id").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    starts = np.array([r.value for r in binary.read_bin(spark, f"{folder}/cluster_offsets.bin", "<i4").orderBy("pos").collect()], dtype=np.int64)

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(starts[:-1], np.asarray(b.column(0)), side="right") - 1  # the last of the clusters that begin there
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(1)], names=["cluster_id", "pos", "vec_id"])

    ids = binary.read_bin(spark, f"{folder}/vector_indices.bin", "<i4").select("pos", F.col("value").cast("bigint").alias("vec_id"))
    raw = binary.read_vectors_bin(spark, f"{folder}/raw_vectors.bin", dim).select(F.col("vec_id").alias("pos"), "embedding")
    return ids.mapInArrow(owner, "cluster_id bigint, pos bigint, vec_id bigint").join(raw, "pos").select("cluster_id", "pos", "vec_id", "embedding"), c


def bfs(spark: SparkSession, a: argparse.Namespace) -> str:
    harness.validate(a.tlb, cache_share=a.cache_perc, tpn=a.tpn)
    e, nodes, source = read_graph(spark, a.data_dir)
    e, nodes = cut(e), cut(nodes)
    deg = graph.degrees(e)
    found: dict[str, tuple] = {}
    for name, width in ((TARGET, 1), (OWN, a.tpn)):
        ms = harness.timed(graph.bfs(e, source, width=width))
        dist = cut(graph.bfs(e, source, width=width))
        found[name] = (ms, dist, graph.bfs_summary(dist, deg).first())
    _, slots = paging.sizing(e.count(), a.cache_perc)
    t = paging.bounded_tier_hits(graph.bfs_trace(e, nodes, found[OWN][1], a.tpn), max(1, slots), a.tlb, "launch").first()
    want, got = found[TARGET][2], found[OWN][2]
    same = (want.nodes_reached, want.max_level) == (got.nodes_reached, got.max_level)
    rows = [
        (TARGET, 1, found[TARGET][0], want.edges_accessed, None, None, None, "REF"),
        (OWN, a.tpn, found[OWN][0], got.edges_accessed, t.t1_hits, t.t2_hits + t.t3_hits, t.misses, "PASS" if same else "FAIL"),
    ]
    return harness.report(rows, harness.BFS_REPORT)


def ann(spark: SparkSession, a: argparse.Namespace) -> str:
    harness.validate(a.tlb, a.wpq, cache_share=a.cache)
    index, c = read_index(spark, a.data_dir, a.dim)
    index, c = cut(index), cut(c)
    q = cut(ivf.sample_clustered(index, min(a.queries, index.count())))
    target = cut(ivf.search(index, c, q, PROBES))
    ms = harness.timed(ivf.search(index, c, q, PROBES))
    own = ivf.search(index.repartition(a.wpq), c, q, PROBES)
    own_ms = harness.timed(own)
    status = harness.verified(OWN, [a.wpq], lambda _: own, target, "query_id", "vec_id").first()["status"]
    _, slots = paging.sizing(index.count() * a.dim, a.cache)
    t = paging.bounded_tier_hits(ivf.search_trace(index, c, q, PROBES, a.dim, a.wpq * 32), max(1, slots), a.tlb).first()
    n = q.count()
    rows = [(TARGET, a.wpq, a.wpq * 32, n, ms, None, None, "REF"), (OWN, a.wpq, a.wpq * 32, n, own_ms, t.t3_hits, t.misses, status)]
    return harness.report(rows, harness.ANN_REPORT)


COMMANDS = {"gen-bfs": gen_bfs, "gen-knn": gen_knn, "bfs": bfs, "ann": ann}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 after a wrong option or value, with the reason on the error stream."""
    p = parser()
    try:
        a, unknown = p.parse_known_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if unknown and a.command != "ann":
        print(f"Error: unknown argument or missing value for {unknown[0]!r}; see --help", file=sys.stderr)
        return 1
    try:
        print(COMMANDS[a.command](spark or local_session(), a))
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
