"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stateword
from ..functions.distance import l2_squared
from ..operators import generators as gen
from ..operators import graph, harness, ivf, paging
from ..operators import vectors as vec
from ..sources import binary, benchlog
from ..session import cut, ensure_checkpoint_dir
from ..sources.tables import event_trace, purchase_edges, purchase_nodes, table, vectors

K = 16
NPROBE = 3
QUERIES = 20
DECIMALS = 6
#: The SQL of the searches takes QUERIES vectors of any table; their NAME_whole take every vector whose id this divides.
EVERY = 100
#: The reference's number of sampled queries.
SAMPLED = 100
#: The SQL of the graph queries takes purchases of so many pieces or more; their NAME_whole take every purchase.
LEAST = 48.0

#: Pages of the last tier in the models of the searches' reads.
BFS_SLOTS, SEARCH_SLOTS = 12, 6
#: Threads of a block in the traces that have blocks.
BLOCK_THREADS = 64
OBSERVED = ("accesses", "t1_hits", "t2_hits")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

LOG = [
    "| Method | WPQ | header |",
    "Target_T |  1 | 32 | 100 | 12.50 | N/A | N/A | REF",
    "BaM      |  1 | 32 | 100 | 15.25 | 4000 | 120 | PASS",
    "BaM_2T\t| 2 | 64 | 100 | 14.75 | 3900 | 220 | PASS",
    "Speedup: 0.8x",
]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def graph_query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers f as NAME on the purchases of LEAST or more, and as NAME_whole on all purchases."""
    REGISTRY[f.__name__] = f
    REGISTRY[f"{f.__name__}_whole"] = partial(f, least=None)
    return f


def search_query(f: Callable[..., DataFrame], name: str | None = None) -> Callable[..., DataFrame]:
    """Registers f as NAME with QUERIES sampled vectors, and as NAME_whole with every vector whose id EVERY divides."""
    REGISTRY[name or f.__name__] = f
    REGISTRY[f"{name or f.__name__}_whole"] = partial(f, whole=True)
    return f


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DECIMALS) for c in cols})


def _queries(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    if whole:
        return vectors(spark, d).filter(F.col("vec_id") % EVERY == 0).select(F.expr(f"vec_id div {EVERY}").alias("query_id"), "vec_id", "embedding")
    return vec.sample_queries(vectors(spark, d), QUERIES)


def _graph(spark: SparkSession, d: str, least: float | None) -> DataFrame:
    return graph.symmetrize(purchase_edges(spark, d, least))


def _source(edges: DataFrame) -> int:
    return graph.pick_source(graph.degrees(edges)).first()["node"]


def _bfs(spark: SparkSession, d: str, least: float | None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    e = cut(_graph(spark, d, least))  # kept in the shared folder, so no memory is held after the query
    return e, graph.bfs(e, _source(e), width=width)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d)
    c = vec.first_vectors(v, K)
    return ivf.build_index(v, c), c


@search_query
def nn_exact_l2(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    q = _queries(spark, d, whole)
    return _round(vec.brute_force_knn(vectors(spark, d), q).drop("rank"), "dist")


@search_query
def knn_topk_exact(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    q = _queries(spark, d, whole).withColumn("query_id", F.col("vec_id"))
    return _round(vec.brute_force_knn(vectors(spark, d), q, k=10, exclude_self=True), "dist")


@query
def l2_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    n = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return _round(v.join(n, "vec_id").select("vec_id", l2_squared(F.col("embedding"), F.col("e2")).alias("dist")), "dist")


@query
def query_sampler(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", "vec_id")


@query
def query_sampler_whole(spark: SparkSession, d: str) -> DataFrame:
    return vec.sample_queries(vectors(spark, d), SAMPLED).select("query_id", "vec_id")


@search_query
def top_centroids(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    v = vectors(spark, d)
    return _round(vec.top_centroids(_queries(spark, d, whole), vec.first_vectors(v, K), 10), "dist")


@query
def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _round(vec.assign(v, vec.first_vectors(v, K)), "dist")


def _kmeans(iters: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = vec.kmeans(vectors(spark, d), 8, iters)
        return c.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "pos", F.round("x", DECIMALS).alias("x"))

    return run


for _n, _it in (("kmeans_step_1", 1), ("kmeans_iter_3", 3), ("kmeans_iter_20", 20)):
    REGISTRY[_n] = _kmeans(_it)


@query
def ivf_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_sizes(*_index(spark, d))


@query
def ivf_offsets(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_offsets(ivf.cluster_sizes(*_index(spark, d)), K)


@query
def ivf_reorder(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[0].select("pos", "cluster_id", "vec_id")


@query
def cluster_size_stats(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_stats(ivf.cluster_sizes(*_index(spark, d)))


def _search(nprobe: int, exclude_self: bool) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
        index, c = _index(spark, d)
        return _round(ivf.search(index, c, _queries(spark, d, whole), nprobe, exclude_self=exclude_self).drop("rank"), "dist")

    return run


search_query(_search(NPROBE, False), "ivf_search")
search_query(_search(10, False), "ivf_search_nprobe10")
search_query(_search(NPROBE, True), "ivf_search_not_self")


@search_query
def ivf_search_recall(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    index, c = _index(spark, d)
    q = _queries(spark, d, whole).withColumn("query_id", F.col("vec_id"))
    found = ivf.search(index, c, q, NPROBE, exclude_self=True)
    return _round(vec.recall_at_k(found, vec.brute_force_knn(vectors(spark, d), q, exclude_self=True)), "recall")


@graph_query
def edges_undirected(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return _graph(spark, d, least)


@graph_query
def degree_table(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.degrees(_graph(spark, d, least), purchase_nodes(spark, d))


@graph_query
def degree_stats(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return _round(graph.degree_stats(graph.degrees(_graph(spark, d, least), purchase_nodes(spark, d))), "avg")


@graph_query
def csr_offsets(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.csr_offsets(_graph(spark, d, least), purchase_nodes(spark, d)).select(F.coalesce("node", F.lit(-1)).alias("node"), "offset", "degree")


@graph_query
def csr_edges(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.csr_edges(_graph(spark, d, least))


@graph_query
def max_degree_source(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.pick_source(graph.degrees(_graph(spark, d, least)))


@graph_query
def graph_metadata(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.graph_metadata(_graph(spark, d, least), purchase_nodes(spark, d))


@graph_query
def frontier_expand_1hop(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    e = _graph(spark, d, least)
    return graph.expand(e, graph.pick_source(graph.degrees(e)))


@graph_query
def bfs_distances(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return _bfs(spark, d, least)[1]


@graph_query
def bfs_frontier_sizes(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.frontier_sizes(_bfs(spark, d, least)[1])


@graph_query
def bfs_summary(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    e, dist = _bfs(spark, d, least)
    return graph.bfs_summary(dist, graph.degrees(e))


@graph_query
def bfs_unreached(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    return graph.unreached(graph.degrees(_graph(spark, d, least)).select("node"), _bfs(spark, d, least)[1])


@query
def gen_hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return gen.hash_elements(spark, 4096).select("t", F.col("value").cast("double").alias("value"))


@query
def gen_warp_shared_trace(spark: SparkSession, d: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName, (gen.warp_shared_trace(spark, 2048, u, 131072).withColumn("shared", F.lit(u)) for u in (1, 2, 4, 8, 16, 32))
    ).select("shared", "seq", "page", "index")


@query
def gen_zipf_cdf(spark: SparkSession, d: str) -> DataFrame:
    return gen.zipf_cdf(spark, 10000).select("page", F.round("hi", 9).alias("hi"))


@query
def gen_strided_trace(spark: SparkSession, d: str) -> DataFrame:
    return gen.strided_trace(spark, 1024, 4096)


@query
def gen_zipf_trace(spark: SparkSession, d: str) -> DataFrame:
    return gen.zipf_trace(spark, 20000, 1000)


@query
def gen_uniform_trace(spark: SparkSession, d: str) -> DataFrame:
    return gen.uniform_trace(spark, 20000, 1 << 20)


@query
def gen_uniform_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrize(gen.uniform_edges(spark, 10, 16))


@query
def gen_rmat_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrize(gen.rmat_edges(spark, 10))


def _backing(spark: SparkSession, count: int = 1048576) -> DataFrame:
    return gen.identity_backing(spark, count)


@query
def gather_by_index(spark: SparkSession, d: str) -> DataFrame:
    return paging.gather(event_trace(spark, d), _backing(spark))


@query
def gather_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return paging.coalesced_gather(event_trace(spark, d), _backing(spark))


@graph_query
def segment_sum(spark: SparkSession, d: str, least: float | None = LEAST) -> DataFrame:
    offsets = cut(graph.csr_offsets(_graph(spark, d, least), purchase_nodes(spark, d)))
    edges = offsets.filter("node IS NULL").first()["offset"]  # the array has a value for each edge, however many there are
    return graph.segment_sum(offsets, _backing(spark, edges))


@query
def page_histogram(spark: SparkSession, d: str) -> DataFrame:
    return paging.page_histogram(event_trace(spark, d))


@query
def coalesced_probes(spark: SparkSession, d: str) -> DataFrame:
    return paging.coalesced_probes(event_trace(spark, d))


@query
def tier_hits_3(spark: SparkSession, d: str) -> DataFrame:
    return paging.tier_hits(event_trace(spark, d), 3)


@query
def tier_hits_2(spark: SparkSession, d: str) -> DataFrame:
    return paging.tier_hits(event_trace(spark, d), 2)


@query
def cache_fifo_sim(spark: SparkSession, d: str) -> DataFrame:
    return paging.fifo_simulate(event_trace(spark, d), [64, 256, 1024])


@query
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = paging.tier_hits(event_trace(spark, d), 3)
    c = t.select("accesses", F.col("t3_hits").alias("hits"), "misses", F.lit(12.5).cast("double").alias("ms"), F.lit(10.0).cast("double").alias("target_ms"))
    return _round(paging.derived_metrics(c), "hit_pct", "gb_per_s", "speedup", "pcie_mb")


@query
def mismatch_report(spark: SparkSession, d: str) -> DataFrame:
    a = paging.gather(event_trace(spark, d), _backing(spark))
    b = a.withColumn("value", F.when(F.col("seq") % 1000 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return paging.mismatches(a, b, "seq", "value")


@query
def bench_log_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in LOG], "value string")
    return benchlog.parse_lines(lines, benchlog.ANN_COLUMNS)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query
def binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    path = f"{_folder(spark)}/vectors.bin"
    binary.write_bin(v, path, "embedding", "<f4", "vec_id")
    back = binary.read_vectors_bin(spark, path, len(v.first()["embedding"]), expected=v.count())
    return paging.mismatches(v, back, "vec_id", "embedding")


@query
def graph_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The purchase graph as the three array files, read again as (pos, dst)."""
    e = cut(_graph(spark, d, None))
    nodes = purchase_nodes(spark, d)
    folder = _folder(spark)
    last = F.coalesce("node", F.lit((1 << 63) - 1))
    edges = cut(graph.csr_edges(e))
    binary.write_graph(graph.csr_offsets(e, nodes).withColumn("node", last), edges, graph.graph_metadata(e, nodes), folder)
    meta = [r.value for r in binary.read_bin(spark, f"{folder}/metadata.bin", "<i8", 4).orderBy("pos").collect()]
    back = binary.read_bin(spark, f"{folder}/edges.bin", "<i4", meta[1]).select("pos", F.col("value").cast("bigint").alias("dst"))
    offsets = binary.read_bin(spark, f"{folder}/offsets.bin", "<u4", meta[0] + 1)
    ends = offsets.agg(F.max("value").alias("last_offset"))
    report = paging.mismatches(edges, back, "pos", "dst")
    return report.join(ends).select("rows", "mismatched", "last_offset", *(F.lit(x).cast("bigint").alias(c) for c, x in zip(("num_nodes", "num_edges", "source", "max_deg"), meta, strict=True)))


@query
def index_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The inverted file as its four array files, the large two in parts, read again by position."""
    index, c = _index(spark, d)
    index = cut(index)
    folder = _folder(spark)
    binary.write_ivf_bin(index, c, ivf.cluster_offsets(ivf.cluster_sizes(index, c), K), folder, parts=True)
    n = index.count()
    dim = len(index.first()["embedding"])
    ids = binary.read_bin(spark, f"{folder}/vector_indices.bin", "<i4", n).select("pos", F.col("value").cast("bigint").alias("vec_id"))
    raw = binary.read_vectors_bin(spark, f"{folder}/raw_vectors.bin", dim, expected=n).select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    both = ids.join(raw, "pos").withColumn("row", F.struct("vec_id", "vector"))
    report = paging.mismatches(index.withColumn("row", F.struct("vec_id", F.col("embedding").alias("vector"))), both, "pos", "row")
    ends = binary.read_bin(spark, f"{folder}/cluster_offsets.bin", "<i4", K + 1).agg(F.max("value").cast("bigint").alias("last_offset"))
    return report.join(ends)


@query
def distribution_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/cluster_distribution.csv"
    binary.write_cluster_distribution(ivf.cluster_sizes(*_index(spark, d)), path)
    return binary.read_cluster_distribution(spark, path).select(F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("size").cast("bigint").alias("size"))


@query
def query_sampler_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The reference's own sampler: places of the cluster-sorted order."""
    return ivf.sample_clustered(_index(spark, d)[0], QUERIES).select("query_id", "vec_id")


@query
def ivf_trained_search(spark: SparkSession, d: str) -> DataFrame:
    """k-means, assignment, inverted file and search in one: queries are sampled from the cluster-sorted order."""
    v = vectors(spark, d)
    c = vec.kmeans(v, 8, 3)
    index = cut(ivf.build_index(v, c))
    q = ivf.sample_clustered(index, QUERIES)
    return _round(ivf.search(index, c, q, NPROBE).drop("rank"), "dist")


@query
def probe_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Probes padded to K + 4 a query with -1, and again without the invalid ones."""
    v = vectors(spark, d)
    probes = vec.pad_probes(vec.top_centroids(_queries(spark, d), vec.first_vectors(v, K), K + 4), K + 4)
    valid = F.count_if(F.col("cluster_id") >= 0)
    return probes.groupBy("query_id").agg(F.count("*").alias("probes"), valid.alias("valid"), F.min("cluster_id").alias("lowest"))


@query
def verify_search(spark: SparkSession, d: str) -> DataFrame:
    """The search with the index in so many partitions, against the search over all clusters' exact target."""
    index, c = _index(spark, d)
    index = cut(index)
    q = cut(_queries(spark, d))
    target = cut(ivf.search(index, c, q, NPROBE))
    return harness.verified("variant", [1, 2, 8], lambda n: ivf.search(index.repartition(n), c, q, NPROBE), target, "query_id", "vec_id")


@query
def verify_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search with the edges in so many partitions: levels and nodes reached against the target's."""
    e, dist = _bfs(spark, d, None)
    source = _source(e)
    target = cut(dist)
    return harness.verified("variant", [1, 32], lambda n: graph.bfs(e, source, width=n), target, "node", "dist")


@query
def mismatch_first(spark: SparkSession, d: str) -> DataFrame:
    a = paging.gather(event_trace(spark, d), _backing(spark))
    b = a.withColumn("value", F.when(F.col("seq") % 1000 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return paging.first_mismatches(a, b, "seq", "value")


@query
def coalesced_probes_step(spark: SparkSession, d: str) -> DataFrame:
    """One probe for each page that a warp wants in one step of its lanes."""
    return paging.coalesced_probes(paging.with_steps(event_trace(spark, d)), "step")


@query
def tier_hits_blocks(spark: SparkSession, d: str) -> DataFrame:
    return paging.tier_hits(event_trace(spark, d, BLOCK_THREADS), 3)


@query
def tier_hits_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return paging.coalesced_tier_hits(paging.with_steps(event_trace(spark, d, BLOCK_THREADS)))


@query
def cache_fifo_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A cache for each block of threads, so that blocks run side by side."""
    return paging.fifo_simulate(event_trace(spark, d, BLOCK_THREADS), [8, 64])


@query
def observed_counters(spark: SparkSession, d: str) -> DataFrame:
    df, seen = paging.observed(event_trace(spark, d))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in OBSERVED)], ", ".join(f"{c} bigint" for c in OBSERVED))


def _tiers_of_bfs(tiers: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e, dist = _bfs(spark, d, None)
        return paging.bounded_tier_hits(graph.bfs_trace(e, purchase_nodes(spark, d), dist), BFS_SLOTS, tiers, "launch")

    return run


REGISTRY["bfs_tiers_3"] = _tiers_of_bfs(3)
REGISTRY["bfs_tiers_2"] = _tiers_of_bfs(2)


def _tiers_of_search(tiers: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        index, c = _index(spark, d)
        q = _queries(spark, d)
        return paging.bounded_tier_hits(ivf.search_trace(index, c, q, NPROBE, len(q.first()["embedding"])), SEARCH_SLOTS, tiers)

    return run


REGISTRY["ivf_tiers_3"] = _tiers_of_search(3)
REGISTRY["ivf_tiers_2"] = _tiers_of_search(2)


@query
def cache_fifo_shared(spark: SparkSession, d: str) -> DataFrame:
    t = gen.warp_shared_trace(spark, 1536, 4, 96).withColumn("block", F.lit(0))
    return paging.fifo_simulate(t, [16, 48]).select("slots", "hits", "misses")


def pin_events(spark: SparkSession) -> DataFrame:
    """Acquires of two readers and releases of one, some of them late and some missing."""
    t = gen.warp_shared_trace(spark, 2048, 4, 96).select(F.col("seq").alias("i"), "page")
    take = t.select((F.col("i") * 16).alias("seq"), "page", F.lit(2).alias("count"))
    give = lambda late: t.filter(F.col("i") % 7 != late).select((F.col("i") * 16 + 1 + F.col("i") % 5 * 16 + late).alias("seq"), "page", F.lit(-1).alias("count"))
    return take.unionByName(give(1)).unionByName(give(2)).withColumn("block", F.expr("seq div 16384"))


@query
def pinned_entries(spark: SparkSession, d: str) -> DataFrame:
    return paging.pinned_entries(pin_events(spark))


@query
def state_words(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    w = stateword.pack(i % 2 == 1, F.expr("id div 2 % 2 = 1"), F.expr("id div 4 % 2 = 1"), i * 2097152)
    words = spark.range(512).select("id", w.alias("word"))
    x = F.col("word")
    return words.select("id", "word", stateword.substate(x).alias("substate"), stateword.readers(x).alias("readers"), stateword.loaded(x).alias("loaded"), stateword.not_busy(x).alias("not_busy"))


@query
def sizing_table(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(1, 40).select((F.col("id") * 99991).alias("elements"))
    shares = F.explode(F.array(*(F.lit(x) for x in (0.1, 0.25, 0.3, 1.0)))).alias("share")
    return paging.sizing_rows(n.select("elements", shares))


@query
def gen_fake_offsets(spark: SparkSession, d: str) -> DataFrame:
    return gen.fake_offsets(spark, 4096, 100_000)


@query
def gen_sequential_trace(spark: SparkSession, d: str) -> DataFrame:
    return gen.sequential_trace(spark, 2048)


@query
def tier_hits_sequential(spark: SparkSession, d: str) -> DataFrame:
    return paging.tier_hits(gen.sequential_trace(spark, 2048), 3)


@query
def bfs_widths(spark: SparkSession, d: str) -> DataFrame:
    """The search for the narrowest and the widest width; the result does not depend on it."""
    out = []
    for width in (harness.THREADS_PER_NODE[0], harness.THREADS_PER_NODE[5]):
        harness.validate(tpn=width)
        e, dist = _bfs(spark, d, None, width)
        out.append(graph.bfs_summary(dist, graph.degrees(e)).withColumn("tpn", F.lit(width)))
    return reduce(DataFrame.unionByName, out)
