"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from .catalog import BFS_SLOTS, BLOCK_THREADS, DECIMALS, EVERY, K, NPROBE, QUERIES, SAMPLED, SEARCH_SLOTS

EDGES = """d1 AS (SELECT DISTINCT 2*o_custkey AS u, 2*l_partkey+1 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 48),
e AS (SELECT u AS src, v AS dst FROM d1 UNION SELECT v, u FROM d1),
nodes AS (SELECT DISTINCT 2*c_custkey AS node FROM customer UNION SELECT DISTINCT 2*p_partkey+1 FROM part),
deg0 AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY 1),
deg AS (SELECT node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg0 USING (node))"""
SOURCE = "source AS (SELECT node, degree FROM deg0 ORDER BY degree DESC, node LIMIT 1)"
BFS = f"""{EDGES}, {SOURCE},
walk(node, dist) AS (SELECT node, 0 FROM source UNION SELECT e.dst, walk.dist + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.dist < 24),
dist AS (SELECT node, min(dist)::INT AS dist FROM walk GROUP BY node)"""
BFS_WITH = f"WITH RECURSIVE {BFS}"


def l2(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda x, y: x+y)"


QUERY_SET = f"""n AS (SELECT count(*) AS n FROM embeddings),
p AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings),
q AS (SELECT p // (n // {QUERIES}) AS query_id, vec_id, embedding FROM p, n WHERE p % (n // {QUERIES}) = 0 AND p // (n // {QUERIES}) < {QUERIES})"""
CENTROIDS = f"c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, embedding AS centroid FROM embeddings ORDER BY vec_id LIMIT {K})"
ASSIGN = f"""{CENTROIDS},
ad AS (SELECT vec_id, cluster_id, {l2("embedding", "centroid")} AS dist FROM embeddings, c),
a AS (SELECT vec_id, cluster_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS r FROM ad) WHERE r = 1)"""
SIZES = f"{ASSIGN}, sizes AS (SELECT c.cluster_id, count(a.vec_id) AS size FROM c LEFT JOIN a USING (cluster_id) GROUP BY 1)"
INDEX = f"{ASSIGN}, ix AS (SELECT row_number() OVER (ORDER BY cluster_id, vec_id) - 1 AS pos, cluster_id, vec_id FROM a)"


def knn(k: int, not_self: bool) -> str:
    cond = "WHERE q.vec_id <> e.vec_id" if not_self else ""
    return f"""kd AS (SELECT q.query_id, q.vec_id AS own, e.vec_id, {l2("q.embedding", "e.embedding")} AS dist FROM q, embeddings e {cond}),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM kd) WHERE rank <= {k})"""


def probe(nprobe: int, not_self: bool) -> str:
    cond = "WHERE q.vec_id <> ix.vec_id" if not_self else ""
    return f"""pd AS (SELECT query_id, q.vec_id, cluster_id, {l2("embedding", "centroid")} AS dist FROM q, c),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS rank FROM pd) WHERE rank <= {nprobe}),
sd AS (SELECT pr.query_id, q.vec_id AS own, ix.vec_id, ix.pos, {l2("q.embedding", "e.embedding")} AS dist
  FROM pr JOIN q USING (query_id) JOIN ix ON ix.cluster_id = pr.cluster_id JOIN embeddings e ON e.vec_id = ix.vec_id {cond}),
found AS (SELECT query_id, own, vec_id, pos, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM sd) WHERE r = 1)"""


def kmeans(iters: int, k: int = 8) -> str:
    parts = [
        "t AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings) WHERE p < (SELECT count(*) // 2 FROM embeddings))",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT {k})",
        "dims AS (SELECT unnest(range(len(x)))::INT AS pos FROM m0 WHERE cluster_id = 0)",
    ]
    for i in range(iters):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, x, cluster_id FROM (SELECT t.vec_id, t.x, m.cluster_id,
 row_number() OVER (PARTITION BY vec_id ORDER BY {l2("t.x", "m.x")}, cluster_id) AS r FROM t, m{i} m) WHERE r = 1),
s{i} AS (SELECT cluster_id, pos, avg(x[pos+1]) AS x FROM a{i}, dims GROUP BY 1, 2),
m{i + 1} AS MATERIALIZED (SELECT m0.cluster_id, list(coalesce(s.x, 0.0) ORDER BY dims.pos) AS x FROM m0 CROSS JOIN dims
 LEFT JOIN s{i} s ON s.cluster_id = m0.cluster_id AND s.pos = dims.pos GROUP BY 1)"""
        )
    return f"WITH {', '.join(parts)} SELECT cluster_id, pos, round(x[pos+1], {DECIMALS}) AS x FROM m{iters}, dims"


TRACE = """t AS (SELECT event_id AS seq, user_id AS thread, user_id // 32 AS warp, (user_id*7919 + event_id*37) % 1048576 AS index,
 ((user_id*7919 + event_id*37) % 1048576) // 1024 AS page FROM events)"""
TIERS = f"""WITH {TRACE},
a AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY thread ORDER BY seq) = page, false) AS h1 FROM t),
b AS (SELECT *, NOT h1 AND coalesce(lag(page) OVER (PARTITION BY h1, page % 32 ORDER BY seq) = page, false) AS h2 FROM a),
s AS (SELECT count(*) AS accesses, count(*) FILTER (h1) AS t1, count(*) FILTER (h2) AS t2, count(DISTINCT page) AS misses FROM b)"""
U32 = "4294967296"
HASH = f"""WITH a AS (SELECT t, (t::HUGEINT * 1664525 + 1013904223 + 42) % {U32} AS h FROM range(4096) r(t)),
b AS (SELECT t, (xor(h::BIGINT, h::BIGINT >> 16)::HUGEINT * 2246822507) % {U32} AS h FROM a),
c AS (SELECT t, (xor(h::BIGINT, h::BIGINT >> 13)::HUGEINT * 3266489909) % {U32} AS h FROM b),
d AS (SELECT t, xor(h::BIGINT, h::BIGINT >> 16) AS h FROM c)
SELECT t, ((h & 16777215)::DOUBLE / 16777216.0)::FLOAT::DOUBLE AS value FROM d"""
SHARED = " UNION ALL ".join(
    f"""SELECT {u}::INT AS shared, t AS seq, (((t // 32) * {u} + (t % 32) % {u})::HUGEINT * 2654435761 % {U32} % 131072)::BIGINT AS page,
(((t // 32) * {u} + (t % 32) % {u})::HUGEINT * 2654435761 % {U32} % 131072)::BIGINT * 1024 + t % 32 AS index FROM range(2048) r(t)"""
    for u in (1, 2, 4, 8, 16, 32)
)

ORACLES: dict[str, str] = {
    "nn_exact_l2": f"WITH {QUERY_SET}, {knn(1, False)} SELECT query_id, vec_id, round(dist, {DECIMALS}) AS dist FROM kn",
    "knn_topk_exact": f"WITH {QUERY_SET}, {knn(10, True)} SELECT own AS query_id, rank::INT AS rank, vec_id, round(dist, {DECIMALS}) AS dist FROM kn",
    "l2_pairs": f"SELECT b.vec_id, round({l2('b.embedding', 'a.embedding')}, {DECIMALS}) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "query_sampler": f"WITH {QUERY_SET} SELECT query_id, vec_id FROM q",
    "top_centroids": f"""WITH {QUERY_SET}, {CENTROIDS}, pd AS (SELECT query_id, cluster_id, {l2("embedding", "centroid")} AS dist FROM q, c)
SELECT query_id, rank::INT AS rank, cluster_id, round(dist, {DECIMALS}) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS rank FROM pd) WHERE rank <= 10""",
    "assign_clusters": f"WITH {ASSIGN} SELECT vec_id, cluster_id, round(dist, {DECIMALS}) AS dist FROM a",
    "kmeans_step_1": kmeans(1),
    "kmeans_iter_3": kmeans(3),
    "kmeans_iter_20": kmeans(20),
    "ivf_cluster_sizes": f"WITH {SIZES} SELECT cluster_id, size FROM sizes",
    "ivf_offsets": f"""WITH {SIZES} SELECT cluster_id, (coalesce(sum(size) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", size FROM sizes
UNION ALL SELECT {K}, sum(size)::BIGINT, 0 FROM sizes""",
    "ivf_reorder": f"WITH {INDEX} SELECT pos, cluster_id, vec_id FROM ix",
    "cluster_size_stats": f"""WITH {SIZES}, r AS (SELECT size, row_number() OVER (ORDER BY size, cluster_id) AS r, count(*) OVER () AS n FROM sizes)
SELECT min(size) AS min, median(size) FILTER (r <= n // 2) AS q1, median(size) AS median, median(size) FILTER (r > (n + 1) // 2) AS q3,
 max(size) AS max, (sum(size) // count(*))::BIGINT AS avg, count(*) FILTER (size = 0) AS empty FROM r""",
    "ivf_search": f"WITH {QUERY_SET}, {INDEX}, {probe(NPROBE, False)} SELECT query_id, vec_id, pos, round(dist, {DECIMALS}) AS dist FROM found",
    "ivf_search_nprobe10": f"WITH {QUERY_SET}, {INDEX}, {probe(10, False)} SELECT query_id, vec_id, pos, round(dist, {DECIMALS}) AS dist FROM found",
    "ivf_search_not_self": f"WITH {QUERY_SET}, {INDEX}, {probe(NPROBE, True)} SELECT query_id, vec_id, pos, round(dist, {DECIMALS}) AS dist FROM found",
    "ivf_search_recall": f"""WITH {QUERY_SET}, {INDEX}, {probe(NPROBE, True)}, {knn(1, True)}
SELECT count(*) AS queries, round(avg((found.vec_id = kn.vec_id)::INT), {DECIMALS}) AS recall FROM kn LEFT JOIN found ON found.query_id = kn.query_id""",
    "edges_undirected": f"WITH {EDGES} SELECT src, dst FROM e",
    "degree_table": f"WITH {EDGES} SELECT node, degree FROM deg",
    "degree_stats": f"""WITH {EDGES}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS r, count(*) OVER () AS n FROM deg)
SELECT max(n) AS n, sum(degree)::BIGINT AS total, round(sum(degree) / max(n), {DECIMALS}) AS avg, min(degree) AS min, max(degree) FILTER (r = floor(n * 0.25)) AS q1,
 max(degree) FILTER (r = floor(n * 0.5)) AS median, max(degree) FILTER (r = floor(n * 0.75)) AS q3, max(degree) AS max FROM r""",
    "csr_offsets": f"""WITH {EDGES} SELECT node, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", degree FROM deg
UNION ALL SELECT -1, sum(degree)::BIGINT, 0 FROM deg""",
    "csr_edges": f"WITH {EDGES} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM e",
    "max_degree_source": f"WITH {EDGES}, {SOURCE} SELECT node, degree FROM source",
    "graph_metadata": f"""WITH {EDGES}, {SOURCE} SELECT (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, node AS source, degree AS max_deg FROM source""",
    "frontier_expand_1hop": f"WITH {EDGES}, {SOURCE} SELECT DISTINCT dst AS node FROM e JOIN source ON e.src = source.node",
    "bfs_distances": f"{BFS_WITH} SELECT node, dist FROM dist",
    "bfs_frontier_sizes": f"{BFS_WITH} SELECT dist AS level, count(*) AS new_nodes FROM dist GROUP BY 1",
    "bfs_summary": f"{BFS_WITH} SELECT max(dist) AS max_level, count(*) AS nodes_reached, sum(degree)::BIGINT AS edges_accessed FROM dist LEFT JOIN deg0 USING (node)",
    "bfs_unreached": f"{BFS_WITH} SELECT node FROM deg0 WHERE node NOT IN (SELECT node FROM dist)",
    "gen_hash_vectors": HASH,
    "gen_warp_shared_trace": SHARED,
    "gen_zipf_cdf": """WITH w AS (SELECT page, 1.0::DOUBLE / (page + 1) AS w FROM range(10000) r(page))
SELECT page, round(sum(w) OVER (ORDER BY page) / (SELECT sum(w) FROM w), 9) AS hi FROM w""",
    "gen_strided_trace": "SELECT t AS seq, t // 4 AS thread, (t % 4096) * 1024 + 7 AS index FROM range(4096) r(t)",
    "gather_by_index": f"WITH {TRACE} SELECT seq, index, index AS value FROM t",
    "gather_coalesced": f"WITH {TRACE} SELECT seq, index, index AS value FROM t",
    "segment_sum": f"""WITH {EDGES}, o AS (SELECT node, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, degree FROM deg)
SELECT node, (degree * o + degree * (degree - 1) // 2)::BIGINT AS total FROM o""",
    "page_histogram": f"WITH {TRACE} SELECT page, count(*) AS accesses, count(DISTINCT index % 1024) AS offsets FROM t GROUP BY 1",
    "coalesced_probes": f"WITH {TRACE} SELECT count(*) AS accesses, count(DISTINCT (warp, page)) AS probes FROM t",
    "tier_hits_3": f"{TIERS} SELECT accesses, t1 AS t1_hits, t2 AS t2_hits, accesses - t1 - t2 - misses AS t3_hits, misses FROM s",
    "tier_hits_2": f"{TIERS} SELECT accesses, t1 AS t1_hits, 0::BIGINT AS t2_hits, accesses - t1 - misses AS t3_hits, misses FROM s",
    "derived_metrics": f"""{TIERS}, m AS (SELECT accesses, accesses - t1 - t2 - misses AS hits, misses, 12.5::DOUBLE AS ms, 10.0::DOUBLE AS target_ms FROM s)
SELECT *, round(hits * 100.0 / (hits + misses), {DECIMALS})::DOUBLE AS hit_pct, greatest(accesses - hits - misses, 0) AS t1_hits,
 round(accesses * 4 / 1e9 / (ms / 1e3), {DECIMALS}) AS gb_per_s, round(target_ms / ms, {DECIMALS}) AS speedup, round(misses * 4096 / 1048576.0, {DECIMALS})::DOUBLE AS pcie_mb FROM m""",
    "mismatch_report": f"WITH {TRACE} SELECT count(*) AS rows, count(*) FILTER (seq % 1000 = 7) AS mismatched FROM t",
    "bench_log_parse": """SELECT * FROM (VALUES ('Target_T', 1::BIGINT, 32::BIGINT, 100::BIGINT, 12.5::DOUBLE, NULL::BIGINT, NULL::BIGINT, 'REF'),
 ('BaM', 1, 32, 100, 15.25, 4000, 120, 'PASS'), ('BaM_2T', 2, 64, 100, 14.75, 3900, 220, 'PASS'))
 v("Method", "WPQ", "Threads_Per_Q", "Blocks", "Time_ms", "VRAM_Hits", "DRAM_Misses", "Status")""",
    "binary_roundtrip": "SELECT count(*) AS rows, 0::BIGINT AS mismatched FROM embeddings",
}

#: The graph queries over all purchases: the same SQL without its filter.
FILTER = " WHERE l_quantity >= 48"
ORACLES |= {f"{name}_whole": sql.replace(FILTER, "") for name, sql in ORACLES.items() if FILTER in sql}

#: The searches over every vector whose id EVERY divides: the same SQL with that query set; the sampler has the reference's number.
WHOLE_SET = f"q AS (SELECT vec_id // {EVERY} AS query_id, vec_id, embedding FROM embeddings WHERE vec_id % {EVERY} = 0)"
ORACLES |= {f"{name}_whole": sql.replace(QUERY_SET, WHOLE_SET) for name, sql in ORACLES.items() if QUERY_SET in sql}
ORACLES["query_sampler_whole"] = ORACLES["query_sampler"].replace(f"n // {QUERIES}", f"n // {SAMPLED}").replace(f"< {QUERIES})", f"< {SAMPLED})")


def draw(row: str, seed: int, salt: int) -> str:
    """The double in [0, 1) of a row: 13 hexadecimal digits of an MD5."""
    return f"(('0x' || substr(md5({row} || ':{seed}:{salt}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def fifo(requests: str, slots: str) -> str:
    """caches: the cache of each size after each request (n from 0, page); requests is a table r, slots a list of rows."""
    return f"""{requests},
caches(slots, n, q, hits, misses) AS (SELECT slots, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT FROM (VALUES {slots}) v(slots)
 UNION ALL SELECT slots, w.n + 1, CASE WHEN list_contains(q, page) THEN q WHEN len(q) = slots THEN list_append(q[2:], page) ELSE list_append(q, page) END,
 hits + list_contains(q, page)::INT, misses + (NOT list_contains(q, page))::INT FROM caches w JOIN r ON r.n = w.n),
ends AS (SELECT slots, max(hits) AS hits, max(misses) AS misses FROM caches GROUP BY 1)"""


def tiers(trace: str, order: str, launch: str, slots: int, two: bool) -> str:
    """The bounded model over a table `trace` (block, thread, page and the columns of the order)."""
    h2 = "false" if two else f"NOT h1 AND coalesce(lag(page) OVER (PARTITION BY {launch} block, h1, page % 32 ORDER BY {order}) = page, false)"
    r = f"""a1 AS MATERIALIZED (SELECT *, coalesce(lag(page) OVER (PARTITION BY {launch} block, thread ORDER BY {order}) = page, false) AS h1 FROM trace),
b1 AS MATERIALIZED (SELECT *, {h2} AS h2 FROM a1),
r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) - 1 AS n, page FROM b1 WHERE NOT h1 AND NOT h2)"""
    return f"""{trace}, {fifo(r, f"({slots})")}
SELECT (SELECT count(*) FROM b1) AS accesses, (SELECT count(*) FROM b1 WHERE h1) AS t1_hits, (SELECT count(*) FROM b1 WHERE h2) AS t2_hits,
 hits AS t3_hits, misses FROM ends"""


BFS_TRACE = f"""WITH RECURSIVE {BFS}, offs AS (SELECT node, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, degree FROM deg),
turns AS (SELECT node, dist AS launch, row_number() OVER (PARTITION BY dist ORDER BY node) - 1 AS turn FROM dist),
reads AS (SELECT launch, turn, o, unnest(range(degree)) AS j FROM turns JOIN offs USING (node) WHERE degree > 0),
trace AS MATERIALIZED (SELECT launch, turn, j, turn * 32 + j % 32 AS thread, (turn * 32 + j % 32) // 1024 AS block, (o + j) // 1024 AS page FROM reads)"""
SEARCH_TRACE = f"""WITH RECURSIVE {QUERY_SET}, {INDEX}, {probe(NPROBE, False)},
reads AS (SELECT pr.query_id, pr.rank, ix.pos, unnest(range(len(q.embedding))) AS e, len(q.embedding) AS dim FROM pr JOIN q USING (query_id) JOIN ix ON ix.cluster_id = pr.cluster_id),
trace AS MATERIALIZED (SELECT query_id, rank, pos, e, query_id AS block, query_id * 32 + e % 32 AS thread, (pos * dim + e) // 1024 AS page FROM reads)"""
for _n, _two in ((3, False), (2, True)):
    ORACLES[f"bfs_tiers_{_n}"] = tiers(BFS_TRACE.replace(FILTER, ""), "launch, turn, j", "launch,", BFS_SLOTS, _two)
    ORACLES[f"ivf_tiers_{_n}"] = tiers(SEARCH_TRACE, "query_id, rank, pos, e", "", SEARCH_SLOTS, _two)

#: Centroids after three Lloyd steps, as the table c.
TRAINED = kmeans(3).removeprefix("WITH ").partition(" SELECT cluster_id, pos, round(")[0] + ", c AS (SELECT cluster_id, x AS centroid FROM m3)"
TRAINED_INDEX = INDEX.replace(CENTROIDS, TRAINED)
CLUSTERED = f"""nn AS (SELECT count(*) AS n FROM embeddings),
q AS (SELECT pos // (n // {QUERIES}) AS query_id, vec_id, embedding FROM ix JOIN embeddings USING (vec_id), nn WHERE pos % (n // {QUERIES}) = 0 AND pos // (n // {QUERIES}) < {QUERIES})"""
SHARED_PAGE = "((((t // 32) * 4 + (t % 32) % 4)::HUGEINT * 2654435761) % 4294967296 % 96)::BIGINT"
SEQUENTIAL = "SELECT t AS seq, t % 2048 // 1024 AS block, t % 2048 AS thread, t % 2048 * 64 + t // 2048 AS index FROM range(131072) r(t)"

ORACLES |= {
    "gen_uniform_trace": f"SELECT t AS seq, floor({draw('t', 42, 3)} * 1048576)::BIGINT AS index FROM range(20000) r(t)",
    "gen_zipf_trace": f"""WITH w AS (SELECT page, 1.0::DOUBLE / (page + 1) AS w FROM range(1000) r(page)),
cdf AS (SELECT page, sum(w) OVER (ORDER BY page) / (SELECT sum(w) FROM w) AS hi FROM w),
d AS (SELECT t AS seq, {draw("t", 42, 4)} AS r FROM range(20000) r(t))
SELECT seq, (coalesce(min(page), 999) * 1024 + floor({draw("seq", 42, 5)} * 1024))::BIGINT AS index FROM d LEFT JOIN cdf ON hi >= r GROUP BY seq""",
    "gen_uniform_graph": f"""WITH d AS (SELECT floor({draw("t", 42, 1)} * 1024)::BIGINT AS u, floor({draw("t", 42, 2)} * 1024)::BIGINT AS v FROM range(8192) r(t))
SELECT u AS src, v AS dst FROM d WHERE u <> v UNION SELECT v, u FROM d WHERE u <> v""",
    "gen_rmat_graph": f"""WITH l AS (SELECT t, k, (('0x' || substr(md5(t || ':42:' || (k // 8)), (4 * (k % 8) + 1)::INT, 4))::BIGINT::DOUBLE / 65536.0::DOUBLE) AS r FROM range({1024 * 16}) a(t), range(10) b(k)),
b AS (SELECT t, sum((r >= 0.57 + 0.19)::BIGINT << (9 - k))::BIGINT AS u, sum(((r >= 0.57 AND r < 0.57 + 0.19) OR r >= 0.57 + 0.19 + 0.19)::BIGINT << (9 - k))::BIGINT AS v FROM l GROUP BY t)
SELECT u AS src, v AS dst FROM b WHERE u <> v UNION SELECT v, u FROM b WHERE u <> v""",
    "gen_fake_offsets": f"""WITH d AS (SELECT t AS node, (floor({draw("t", 123, 6)} * 32) + 16)::BIGINT AS degree FROM range(4096) r(t)),
o AS (SELECT node, degree, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM d)
SELECT node, least(o, 100000) AS "offset", least(o + degree, 100000) - least(o, 100000) AS degree FROM o""",
    "gen_sequential_trace": SEQUENTIAL,
    "tier_hits_sequential": f"""WITH t AS (SELECT *, index // 1024 AS page FROM ({SEQUENTIAL})),
a AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY block, thread ORDER BY seq) = page, false) AS h1 FROM t),
b AS (SELECT *, NOT h1 AND coalesce(lag(page) OVER (PARTITION BY block, h1, page % 32 ORDER BY seq) = page, false) AS h2 FROM a)
SELECT count(*) AS accesses, count(*) FILTER (h1) AS t1_hits, count(*) FILTER (h2) AS t2_hits,
 count(*) - count(*) FILTER (h1) - count(*) FILTER (h2) - count(DISTINCT page) AS t3_hits, count(DISTINCT page) AS misses FROM b""",
    "cache_fifo_shared": f"WITH RECURSIVE {fifo(f'r AS MATERIALIZED (SELECT t AS n, {SHARED_PAGE} AS page FROM range(1536) x(t))', '(16), (48)')} SELECT slots::INT AS slots, hits, misses FROM ends",
    "pinned_entries": f"""WITH RECURSIVE p AS (SELECT t, {SHARED_PAGE} AS page FROM range(2048) r(t)),
ev AS (SELECT t * 16 AS seq, page, 2 AS c FROM p UNION ALL SELECT t * 16 + 1 + t % 5 * 16 + late, page, -1 FROM p, (VALUES (1), (2)) l(late) WHERE t % 7 <> late),
e AS MATERIALIZED (SELECT seq // 16384 AS block, page % 32 AS entry, page, c, row_number() OVER (PARTITION BY seq // 16384, page % 32 ORDER BY seq) AS n FROM ev),
walk(block, entry, n, page, hits, misses, conflicts, released, pins) AS (
 SELECT DISTINCT block, entry, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e
 UNION ALL SELECT w.block, w.entry, w.n + 1,
  CASE WHEN c > 0 AND w.page <> e.page AND (w.page = -1 OR pins = 0) THEN e.page ELSE w.page END,
  hits + (c > 0 AND w.page = e.page)::INT, misses + (c > 0 AND w.page <> e.page AND (w.page = -1 OR pins = 0))::INT,
  conflicts + (c > 0 AND w.page <> e.page AND w.page <> -1 AND pins > 0)::INT, released + (c > 0 AND w.page <> e.page AND w.page <> -1 AND pins = 0)::INT,
  CASE WHEN w.page = e.page THEN greatest(0, pins + c) WHEN c > 0 AND (w.page = -1 OR pins = 0) THEN c ELSE pins END
 FROM walk w JOIN e ON e.block = w.block AND e.entry = w.entry AND e.n = w.n + 1)
SELECT block, entry, hits, misses, conflicts, released, pins AS pinned FROM walk QUALIFY row_number() OVER (PARTITION BY block, entry ORDER BY n DESC) = 1""",
    "state_words": """WITH a AS (SELECT t AS id, (t * 2097152) & 536870911 AS readers, t % 2 AS v, t // 2 % 2 AS b, t // 4 % 2 AS d FROM range(512) r(t)),
w AS (SELECT id, readers, v, b, v * 2147483648 + b * 1073741824 + d * 536870912 + readers AS word FROM a)
SELECT id, word, (['NV_NB', 'NV_B', 'V_NB', 'V_B'])[v * 2 + b + 1] AS substate, readers, xor(word, 3221225472) AS loaded, word - b * 1073741824 AS not_busy FROM w""",
    "sizing_table": """SELECT t * 99991 AS elements, s AS share, ceil(t * 99991 / 1024)::BIGINT AS pages, floor(ceil(t * 99991 / 1024)::FLOAT * s::FLOAT)::BIGINT AS cache_pages
FROM range(1, 40) r(t), (VALUES (0.1::DOUBLE), (0.25), (0.3), (1.0)) v(s)""",
    "graph_file_roundtrip": f"""WITH {EDGES}, {SOURCE} SELECT count(*) AS rows, 0::BIGINT AS mismatched, count(*) AS last_offset, (SELECT count(*) FROM nodes) AS num_nodes, count(*) AS num_edges,
 (SELECT node FROM source) AS source, (SELECT degree FROM source) AS max_deg FROM e""",
    "index_file_roundtrip": "SELECT count(*) AS rows, 0::BIGINT AS mismatched, count(*) AS last_offset FROM embeddings",
    "distribution_roundtrip": f"WITH {SIZES} SELECT cluster_id, size FROM sizes",
    "query_sampler_clustered": f"WITH {INDEX}, {CLUSTERED} SELECT query_id, vec_id FROM q",
    "ivf_trained_search": f"WITH {TRAINED_INDEX}, {CLUSTERED}, {probe(NPROBE, False)} SELECT query_id, vec_id, pos, round(dist, {DECIMALS}) AS dist FROM found",
    "probe_matrix": f"WITH {QUERY_SET} SELECT query_id, {K + 4}::BIGINT AS probes, {K}::BIGINT AS valid, -1::BIGINT AS lowest FROM q",
    "verify_search": f"""WITH {QUERY_SET}, {INDEX}, {probe(NPROBE, False)} SELECT 'variant' AS method, v AS value, (SELECT count(*) FROM found) AS rows, 0::BIGINT AS mismatched, 'PASS' AS status
FROM (VALUES (1::BIGINT), (2), (8)) x(v)""",
    "verify_bfs": f"{BFS_WITH} SELECT 'variant' AS method, v AS value, (SELECT count(*) FROM dist) AS rows, 0::BIGINT AS mismatched, 'PASS' AS status FROM (VALUES (1::BIGINT), (32)) x(v)",
    "bfs_widths": f"{BFS_WITH}, s AS (SELECT max(dist) AS max_level, count(*) AS nodes_reached, sum(degree)::BIGINT AS edges_accessed FROM dist LEFT JOIN deg0 USING (node)) SELECT s.*, tpn FROM s, (VALUES (1), (32)) x(tpn)",
    "mismatch_first": f"WITH {TRACE} SELECT seq, index AS expected, index + 1 AS got FROM t WHERE seq % 1000 = 7 ORDER BY seq LIMIT 5",
    "coalesced_probes_step": f"""WITH {TRACE}, s AS (SELECT warp, page, row_number() OVER (PARTITION BY thread ORDER BY seq) AS step FROM t)
SELECT count(*) AS accesses, count(DISTINCT (warp, page, step)) AS probes FROM s""",
    "observed_counters": f"{TIERS} SELECT accesses, t1 AS t1_hits, t2 AS t2_hits FROM s",
}

ORACLES |= {
    "tier_hits_blocks": f"""WITH {TRACE}, b0 AS (SELECT *, thread // {BLOCK_THREADS} AS block FROM t),
a AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY block, thread ORDER BY seq) = page, false) AS h1 FROM b0),
b AS (SELECT *, NOT h1 AND coalesce(lag(page) OVER (PARTITION BY block, h1, page % 32 ORDER BY seq) = page, false) AS h2 FROM a)
SELECT count(*) AS accesses, count(*) FILTER (h1) AS t1_hits, count(*) FILTER (h2) AS t2_hits,
 count(*) - count(*) FILTER (h1) - count(*) FILTER (h2) - count(DISTINCT page) AS t3_hits, count(DISTINCT page) AS misses FROM b""",
    "tier_hits_coalesced": f"""WITH {TRACE}, s AS (SELECT *, thread // {BLOCK_THREADS} AS block, row_number() OVER (PARTITION BY thread ORDER BY seq) AS step FROM t),
a AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY block, thread ORDER BY seq) = page, false) AS h1 FROM s),
l AS (SELECT block, warp, step, page, min(seq) AS seq FROM a WHERE NOT h1 GROUP BY ALL),
b AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY block, page % 32 ORDER BY seq) = page, false) AS h2 FROM l)
SELECT (SELECT count(*) FROM a) AS accesses, (SELECT count(*) FROM a WHERE h1) AS t1_hits, count(*) AS probes, count(*) FILTER (h2) AS t2_hits,
 count(*) - count(*) FILTER (h2) - count(DISTINCT page) AS t3_hits, count(DISTINCT page) AS misses FROM b""",
    "cache_fifo_blocks": f"""WITH RECURSIVE {TRACE}, r AS MATERIALIZED (SELECT thread // {BLOCK_THREADS} AS cache, page, row_number() OVER (PARTITION BY thread // {BLOCK_THREADS} ORDER BY seq) AS n FROM t),
walk(cache, slots, n, q, hits, misses) AS (SELECT DISTINCT cache, slots, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT FROM r, (VALUES (8), (64)) v(slots)
 UNION ALL SELECT w.cache, slots, w.n + 1, CASE WHEN list_contains(q, page) THEN q WHEN len(q) = slots THEN list_append(q[2:], page) ELSE list_append(q, page) END,
 hits + list_contains(q, page)::INT, misses + (NOT list_contains(q, page))::INT FROM walk w JOIN r ON r.cache = w.cache AND r.n = w.n + 1)
SELECT cache, slots::INT AS slots, max(hits) AS hits, max(misses) AS misses FROM walk GROUP BY ALL""",
}
ORACLES["cache_fifo_sim"] = f"""WITH RECURSIVE {fifo(f"{TRACE}, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) - 1 AS n, page FROM t)", "(64), (256), (1024)")}
SELECT 0::BIGINT AS cache, slots::INT AS slots, hits, misses FROM ends"""
for _n in ("graph_file_roundtrip", "verify_bfs", "bfs_widths"):
    ORACLES[_n] = ORACLES[_n].replace(FILTER, "")
