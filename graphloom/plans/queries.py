"""The driver's queries on the given tables, each beside the DuckDB SQL it is checked against.

The test graph joins suppliers that share orders and keeps the heaviest tenth of the pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import metrics, stats
from graphloom.functions.storage import materialise, shared_dir
from graphloom.operators import cores, features, graph, networks, partitions, paths, peel, snapshots
from graphloom.operators.components import connected_components
from graphloom.plans import generate
from graphloom.streaming import peaks

EPS = 1e4
SWEEP = [1.0, 1e2, 1e4, 1e6]
K = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_GRAPH = """ls AS (SELECT DISTINCT l_orderkey AS o, l_suppkey::BIGINT AS s FROM lineitem),
pw AS (SELECT a.s AS src, b.s AS dst, count(*)::BIGINT AS weight FROM ls a JOIN ls b ON a.o = b.o AND a.s < b.s GROUP BY ALL),
e AS MATERIALIZED (SELECT src, dst, weight FROM pw WHERE weight >= (SELECT quantile_disc(weight, 0.9) FROM pw)),
sym AS MATERIALIZED (SELECT src AS s, dst AS d FROM e UNION ALL SELECT dst, src FROM e),
vtx AS (SELECT s_suppkey::BIGINT AS node FROM supplier),
rich AS (SELECT s_suppkey::BIGINT AS node FROM supplier WHERE s_acctbal > 0),
part0 AS (SELECT s_suppkey::BIGINT AS node, floor((s_acctbal + 1000) / 1000)::BIGINT AS cluster_id FROM supplier),
lab AS (SELECT s_suppkey::BIGINT AS node, n_regionkey::BIGINT AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_DEG = "dg AS (SELECT node, count(d)::BIGINT AS deg FROM vtx LEFT JOIN sym ON s = node GROUP BY node)"
_CC = """reach0(a, b) AS (SELECT node, node FROM vtx UNION SELECT a, d FROM reach0 JOIN sym ON s = b),
cc AS MATERIALIZED (SELECT a AS node, min(b) AS component FROM reach0 GROUP BY a)"""
_PEEL = """peel0(it, node, deg, alive) AS (
  SELECT 0, NULL::BIGINT, NULL::BIGINT, (SELECT list(node ORDER BY node) FROM vtx)
  UNION ALL
  SELECT it + 1, p.n, p.dg, list_filter(alive, lambda x: x <> p.n) FROM (
    SELECT it, alive, (SELECT arg_min({'n': n, 'dg': dg}, (dg, n)) FROM (
      SELECT a.n AS n, count(sym.d) AS dg FROM unnest(alive) a(n) LEFT JOIN sym ON sym.s = a.n AND list_contains(alive, sym.d) GROUP BY a.n)) AS p
    FROM peel0 WHERE len(alive) > 0)),
po AS MATERIALIZED (SELECT it::BIGINT AS pos, node, deg::BIGINT AS deg FROM peel0 WHERE it > 0)"""
_SNAP = f"""{_PEEL},
oe AS MATERIALIZED (SELECT sym.s, sym.d, a.pos AS sp, b.pos AS dp FROM sym JOIN po a ON a.node = s JOIN po b ON b.node = d),
mem(pos, x) AS (SELECT pos, node FROM po UNION SELECT mem.pos, oe.d FROM mem JOIN oe ON oe.s = mem.x AND oe.sp >= mem.pos AND oe.dp >= mem.pos),
mm AS MATERIALIZED (SELECT * FROM mem),
ie AS (SELECT mm.pos, oe.s, oe.d FROM mm JOIN oe ON oe.s = mm.x AND oe.sp >= mm.pos AND oe.dp >= mm.pos),
ik AS (SELECT mm.pos, mm.x, count(ie.d) AS k FROM mm LEFT JOIN ie ON ie.pos = mm.pos AND ie.s = mm.x GROUP BY ALL),
iq AS (SELECT ie.pos, sum((a.k - b.k) * (a.k - b.k)) / 2 AS q FROM ie JOIN ik a ON a.pos = ie.pos AND a.x = ie.s JOIN ik b ON b.pos = ie.pos AND b.x = ie.d GROUP BY ie.pos),
sn AS MATERIALIZED (SELECT po.pos, po.node, po.deg, count(*)::BIGINT AS nc, sum(ik.k)::BIGINT AS sum_deg, coalesce(max(iq.q), 0)::BIGINT AS q
  FROM po JOIN ik ON ik.pos = po.pos LEFT JOIN iq ON iq.pos = po.pos GROUP BY po.pos, po.node, po.deg)"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the graph's common table expressions."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _sql(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([_GRAPH, *more])}\n{body}"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"))


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return graph.heaviest(graph.project_pairs(_t(spark, d, "lineitem"), "l_suppkey", "l_orderkey"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph's edges, written once: deriving them is the dearest step of most queries."""
    return materialise(weighted(spark, d).select("src", "dst"), "edges")


def rich(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("bigint").alias("node"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), F.floor((F.col("s_acctbal") + 1000) / 1000).cast("bigint").alias("cluster_id"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").cast("bigint").alias("node"), F.col("n_regionkey").cast("bigint").alias("label"))


def snaps(spark: SparkSession, d: str) -> DataFrame:
    return materialise(snapshots.snapshots(vertices(spark, d), edges(spark, d)), "snapshots")


# the graph itself


query("supplier_pairs", _sql("SELECT src, dst, weight FROM e"))(weighted)


@query("degree_dist", _sql("SELECT deg, count(*)::BIGINT AS n FROM dg GROUP BY deg", _DEG))
def degree_dist(spark, d):
    return graph.degree(vertices(spark, d), weighted(spark, d)).groupBy("deg").agg(F.count(F.lit(1)).alias("n"))


@query("edge_symmetrize", _sql("SELECT s, d FROM sym"))
def edge_symmetrize(spark, d):
    return graph.symmetrise(weighted(spark, d))


@query("edge_canonical", _sql("SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM sym WHERE s <> d"))
def edge_canonical(spark, d):
    e = edges(spark, d)
    return graph.simple(graph.symmetrise(e), "s", "d", rows=2 * e.count())


@query("out_degree", _sql("SELECT node, count(dst)::BIGINT AS deg FROM vtx LEFT JOIN e ON src = node GROUP BY node"))
def out_degree(spark, d):
    return graph.out_degree(vertices(spark, d), weighted(spark, d))


@query("neighbour_degree_sum", _sql("SELECT vtx.node, coalesce(sum(dg.deg), 0)::BIGINT AS nbr_deg FROM vtx LEFT JOIN sym ON s = vtx.node LEFT JOIN dg ON dg.node = d GROUP BY vtx.node", _DEG))
def neighbour_degree_sum(spark, d):
    return graph.neighbour_degree_sum(vertices(spark, d), edges(spark, d))


@query("induced_subgraph", _sql("SELECT src, dst FROM e WHERE src IN (FROM rich) AND dst IN (FROM rich)"))
def induced_subgraph(spark, d):
    return graph.induced(weighted(spark, d), rich(spark, d)).select("src", "dst")


@query("set_neighbors_in_out", _sql("SELECT DISTINCT d AS node, d IN (FROM rich) AS inside FROM sym WHERE s IN (FROM rich)"))
def set_neighbors_in_out(spark, d):
    a, b = graph.neighbours(edges(spark, d), rich(spark, d))
    return a.withColumn("inside", F.lit(True)).unionByName(b.withColumn("inside", F.lit(False)))


@query("subgraph_density", _sql("""SELECT count(*)::BIGINT AS size, (sum(deg) / 2)::BIGINT AS n_edges, min(deg)::BIGINT AS min_deg, round(avg(deg), 9) AS avg_deg, max(deg)::BIGINT AS max_deg,
round(sum(deg) / (count(*) * (count(*) - 1)), 9) AS density, (SELECT count(DISTINCT c) = 1 FROM rc) AS connected FROM id""",
    "ie AS MATERIALIZED (SELECT s, d FROM sym WHERE s IN (FROM rich) AND d IN (FROM rich))", "id AS (SELECT node, count(d) AS deg FROM rich LEFT JOIN ie ON s = node GROUP BY node)",
    "rr(a, b) AS (SELECT node, node FROM rich UNION SELECT a, d FROM rr JOIN ie ON s = b)", "rc AS (SELECT a, min(b) AS c FROM rr GROUP BY a)"))
def subgraph_density(spark, d):
    s = graph.set_statistics(edges(spark, d), rich(spark, d))
    return s.withColumns({c: F.round(c, 9) for c in ("avg_deg", "density")})


@query("connected_components", _sql("SELECT node, component FROM cc", _CC))
def components(spark, d):
    return connected_components(vertices(spark, d), edges(spark, d))


# cores and the peel


@query("kcore_k", _sql("SELECT unnest(alive) AS node FROM kc WHERE it = (SELECT max(it) FROM kc)",
    f"""kc(it, alive, n) AS (SELECT 0, (SELECT list(node ORDER BY node) FROM vtx), -1 UNION ALL
  SELECT it + 1, nx, len(alive) FROM (SELECT it, alive, n, coalesce((SELECT list(n ORDER BY n) FROM (SELECT a.n AS n FROM unnest(alive) a(n) JOIN sym ON s = a.n AND list_contains(alive, d) GROUP BY a.n HAVING count(*) >= {K})), []) AS nx
  FROM kc WHERE n <> len(alive)))"""))  # fmt: skip
def kcore_k(spark, d):
    return cores.kcore(edges(spark, d), K)


@query("core_numbers", _sql("SELECT node, max(deg) OVER (ORDER BY pos)::BIGINT AS core FROM po", _PEEL))
def core_numbers(spark, d):
    return cores.core_numbers(vertices(spark, d), edges(spark, d))


@query("core_numbers_by_rounds", _sql("SELECT node, max(deg) OVER (ORDER BY pos)::BIGINT AS core FROM po", _PEEL))
def core_numbers_by_rounds(spark, d):
    """The way taken by graphs beyond one task."""
    return cores.core_rounds(vertices(spark, d), edges(spark, d))


@query("degeneracy", _sql("SELECT max(deg)::BIGINT AS degeneracy FROM po", _PEEL))
def degeneracy(spark, d):
    return cores.degeneracy(vertices(spark, d), edges(spark, d))


_SWEEP = """cn AS MATERIALIZED (SELECT node, max(deg) OVER (ORDER BY pos)::BIGINT AS core FROM po),
ks AS (SELECT unnest(range(1, (SELECT max(core) FROM cn) + 1))::BIGINT AS k),
cs AS (SELECT k, (SELECT count(*) FROM cn WHERE core >= k)::BIGINT AS size, (SELECT count(*) FROM e JOIN cn a ON a.node = src JOIN cn b ON b.node = dst WHERE least(a.core, b.core) >= k)::BIGINT AS n_edges FROM ks)"""


@query("core_sweep", _sql("SELECT k, size, n_edges, round(n_edges * 2.0 / size, 9) AS avg_deg FROM cs", _PEEL, _SWEEP))
def core_sweep(spark, d):
    return cores.core_sweep(vertices(spark, d), edges(spark, d)).withColumn("avg_deg", F.round("avg_deg", 9))


@query("best_kcore", _sql("SELECT k, size, n_edges, round(n_edges * 2.0 / size, 9) AS avg_deg FROM cs WHERE k BETWEEN 3 AND 30 ORDER BY n_edges * 2.0 / size DESC, size DESC, k DESC LIMIT 1", _PEEL, _SWEEP))
def best_kcore(spark, d):
    return cores.best_kcore(vertices(spark, d), edges(spark, d)).withColumn("avg_deg", F.round("avg_deg", 9))


@query("peel_order", _sql("SELECT pos, node, deg FROM po", _PEEL))
def peel_order(spark, d):
    return peel.peel_order(vertices(spark, d), edges(spark, d))


@query("edge_orientation", _sql("SELECT CASE WHEN a.pos > b.pos THEN src ELSE dst END AS earlier, CASE WHEN a.pos > b.pos THEN dst ELSE src END AS later FROM e JOIN po a ON a.node = src JOIN po b ON b.node = dst", _PEEL))
def edge_orientation(spark, d):
    e = edges(spark, d)
    return peel.oriented(e, materialise(peel.peel_order(vertices(spark, d), e), "order"))


_SUFFIX = "sf AS MATERIALIZED (SELECT pos, count(*) OVER w AS n, sum(deg) OVER w AS m FROM po WINDOW w AS (ORDER BY pos DESC))"


@query("peel_suffixes", _sql("SELECT pos, n::BIGINT AS n, m::BIGINT AS m FROM sf", _PEEL, _SUFFIX))
def peel_suffixes(spark, d):
    return peel.suffixes(vertices(spark, d), edges(spark, d))


@query("charikar_densest", _sql("SELECT pos, n::BIGINT AS n, m::BIGINT AS m, round(m * 2.0 / n, 9) AS value FROM sf WHERE n > 10 ORDER BY m * 2.0 / n DESC, n DESC LIMIT 1", _PEEL, _SUFFIX))
def charikar_densest(spark, d):
    return peel.densest(vertices(spark, d), edges(spark, d)).withColumn("value", F.round("value", 9))


@query("dense_suffix", _sql("SELECT pos, n::BIGINT AS n, m::BIGINT AS m, round(m * 2.0 / (n * (n - 1)), 9) AS value FROM sf WHERE n > 10 ORDER BY round(m * 2.0 / (n * (n - 1)), 12) DESC, n DESC LIMIT 1", _PEEL, _SUFFIX))
def dense_suffix(spark, d):
    return peel.dense_suffix(vertices(spark, d), edges(spark, d)).withColumn("value", F.round("value", 9))


@query("charikar_density", _sql("SELECT pos, n::BIGINT AS n, m::BIGINT AS m, round(m / n, 9) AS value FROM sf ORDER BY m / n DESC, n DESC LIMIT 1", _PEEL, _SUFFIX))
def charikar_density(spark, d):
    return peel.charikar_density(vertices(spark, d), edges(spark, d)).withColumn("value", F.round("value", 9))


# snapshots


_CORE = "cn AS MATERIALIZED (SELECT node, max(deg) OVER (ORDER BY pos)::BIGINT AS core FROM po)"
_CORE_COMPONENTS = """kr(k, a, b) AS (SELECT k, node, node FROM (SELECT unnest(range(1, (SELECT max(core) FROM cn) + 1))::BIGINT AS k) JOIN cn ON core >= k
 UNION SELECT k, a, d FROM kr JOIN sym ON s = b JOIN cn ON cn.node = d AND core >= k),
kc AS MATERIALIZED (SELECT k, a AS node, min(b) AS least FROM kr GROUP BY k, a),
kz AS (SELECT k, least, count(*)::BIGINT AS size FROM kc GROUP BY k, least)"""


@query("rmc_best", _sql("SELECT max(nc * deg)::BIGINT AS rmc FROM sn", _SNAP))
def rmc_best(spark, d):
    """From the components of the k-cores; the snapshots give the same number, in the SQL."""
    v, e = vertices(spark, d), edges(spark, d)
    return cores.rmc(cores.core_numbers(v, e), e)


@query("rmc_best_by_rounds", _sql("SELECT max(nc * deg)::BIGINT AS rmc FROM sn", _SNAP))
def rmc_best_by_rounds(spark, d):
    """The way taken by graphs beyond one task: numbers settled region by region, no peel."""
    v, e = vertices(spark, d), edges(spark, d)
    return cores.rmc(materialise(cores.core_rounds(v, e), "cores"), e)


@query("rmc_members", _sql("SELECT k, node FROM kc JOIN (SELECT k, least FROM kz ORDER BY k * size DESC, k DESC, least LIMIT 1) USING (k, least)", _PEEL, _CORE, _CORE_COMPONENTS))
def rmc_members(spark, d):
    v, e = vertices(spark, d), edges(spark, d)
    return cores.rmc_members(materialise(cores.core_numbers(v, e), "cores"), e)


@query("largest_core_components", _sql("SELECT k, max(size)::BIGINT AS size FROM kz GROUP BY k", _PEEL, _CORE, _CORE_COMPONENTS))
def largest_core_components(spark, d):
    """The size of the largest component of every k-core, from the core forest."""
    v, e = vertices(spark, d), edges(spark, d)
    core = materialise(cores.core_numbers(v, e), "cores")
    return cores.largest_components(core, e)


@query("snapshot_stats", _sql("SELECT node, deg, nc, sum_deg, q FROM sn", _SNAP))
def snapshot_stats(spark, d):
    return snapshots.snapshots(vertices(spark, d), edges(spark, d)).select("node", "deg", "nc", "sum_deg", "q")


@query("fullgraph_degree_q", _sql("""SELECT po.node, (SELECT sum(ik.k * dg.deg * dg.deg) FROM ik JOIN dg ON dg.node = ik.x WHERE ik.pos = po.pos)::BIGINT
 - coalesce((SELECT sum(a.deg * b.deg) FROM ie JOIN dg a ON a.node = ie.s JOIN dg b ON b.node = ie.d WHERE ie.pos = po.pos), 0)::BIGINT AS q_full FROM po""", _SNAP, _DEG))
def fullgraph_degree_q(spark, d):
    return snapshots.snapshots(vertices(spark, d), edges(spark, d)).select("node", "q_full")


@query("energy_best", _sql(f"SELECT mm.x AS node, b.nc, round(b.nc / (b.q + {EPS}), 12) AS score FROM (SELECT * FROM sn ORDER BY nc / (q + {EPS}) DESC, nc DESC, pos DESC LIMIT 1) b JOIN mm ON mm.pos = b.pos", _SNAP))
def energy_best(spark, d):
    s = snaps(spark, d)
    top = materialise(snapshots.best(s, snapshots.score(EPS)), "best")
    m = snapshots.members(s, top)
    return m.join(top.select("component", "sid", "nc", "score"), ["component", "sid"]).select("node", "nc", F.round("score", 12).alias("score"))


@query("snapshot_score_eps_sweep", _sql(f"SELECT eps, round(max(nc / (q + eps)), 12) AS best_score FROM sn, (SELECT unnest({SWEEP})::DOUBLE AS eps) GROUP BY eps", _SNAP))
def snapshot_score_eps_sweep(spark, d):
    s = snapshots.snapshots(vertices(spark, d), edges(spark, d))
    return snapshots.score_sweep(s, SWEEP).withColumn("best_score", F.round("best_score", 12))


@query("best_snapshot_per_node", _sql(f"SELECT x AS node, arg_max(sn.node, (nc / (q + {EPS}), nc, sn.pos)) AS made_by, max(nc / (q + {EPS})).round(12) AS score FROM mm JOIN sn USING (pos) GROUP BY x", _SNAP))
def best_snapshot_per_node(spark, d):
    s = snaps(spark, d)
    b = snapshots.best_per_node(s, snapshots.score(EPS))
    made = s.select("component", "sid", F.col("node").alias("made_by"))
    return b.join(made, ["component", "sid"]).select("node", "made_by", F.round("score", 12).alias("score"))


@query("best_partition", _sql(f"""SELECT node, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS cluster_id FROM (SELECT node, min(node) OVER (PARTITION BY made) AS first FROM
 (SELECT x AS node, arg_max(pos, (nc / (q + {EPS}), nc, pos)) AS made FROM mm JOIN sn USING (pos) GROUP BY x))""", _SNAP))
def best_partition(spark, d):
    return snapshots.best_partition(materialise(snapshots.best_per_node(snaps(spark, d), snapshots.score(EPS)), "best"))


_PEAK = f"pk AS (SELECT component, arg_max(pos, (nc / (q + {EPS}), nc, pos)) AS pos FROM sn JOIN cc USING (node) WHERE nc > 1 GROUP BY component)"
_PEAK_ROWS = f"SELECT pk.component, sn.nc, round(sn.nc / (sn.q + {EPS}), 12) AS score FROM pk JOIN sn USING (pos)"


@query("peak_per_component", _sql(_PEAK_ROWS, _SNAP, _CC, _PEAK))
def peak_per_component(spark, d):
    s = snapshots.snapshots(vertices(spark, d), edges(spark, d))
    return snapshots.peak_per_component(s, snapshots.score(EPS)).select("component", "nc", F.round("score", 12).alias("score"))


@query("uncovered_singletons", _sql("SELECT node FROM vtx WHERE node NOT IN (SELECT mm.x FROM pk JOIN mm USING (pos))", _SNAP, _CC, _PEAK))
def uncovered_singletons(spark, d):
    s = snaps(spark, d)
    return snapshots.uncovered(vertices(spark, d), snapshots.members(s, snapshots.peak_per_component(s, snapshots.score(EPS))))


@query("lowq_mask", _sql("""SELECT node, nc, q FROM sn WHERE nc > 1 AND q <= (SELECT q FROM (SELECT q, row_number() OVER (ORDER BY q) - 1 AS r FROM sn),
 (SELECT least(i0 + greatest(50, floor(0.05 * (n - i0))), n - 1) AS cut FROM (SELECT count(*) AS n, count_if(q <= 0) AS i0 FROM sn) z) y WHERE r = cut)""", _SNAP))
def lowq_mask(spark, d):
    return snapshots.low_energy(snaps(spark, d)).select("node", "nc", "q")


@query("seed_rank", _sql(f"SELECT row_number() OVER (ORDER BY nc / (q + {EPS}) DESC, component, pos DESC)::BIGINT AS rank, sn.node, nc, round(nc / (q + {EPS}), 12) AS score FROM sn JOIN cc USING (node) QUALIFY rank <= 50", _SNAP, _CC))
def seed_rank(spark, d):
    s = snaps(spark, d)
    r = snapshots.ranked(s, snapshots.score(EPS), 50)
    return r.join(s.select("component", "sid", "node"), ["component", "sid"]).select("rank", "node", "nc", F.round("score", 12).alias("score"))


# every step of the replay (a vertex, or one more of its edges) with the set that it makes, by definition
_STEPS = f"""st AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos DESC, d NULLS FIRST) AS k, node AS u, d AS x FROM
 (SELECT pos, node, NULL AS d FROM po UNION ALL SELECT a.pos, a.node, sym.d FROM po a JOIN sym ON s = a.node JOIN po b ON b.node = d WHERE b.pos > a.pos)),
en AS MATERIALIZED (SELECT k, u AS a, x AS b FROM st WHERE x IS NOT NULL UNION ALL SELECT k, x, u FROM st WHERE x IS NOT NULL),
rs(k, a) AS (SELECT k, u FROM st UNION SELECT rs.k, en.b FROM rs JOIN en ON en.a = rs.a AND en.k <= rs.k),
rm AS MATERIALIZED (SELECT * FROM rs),
rd AS MATERIALIZED (SELECT rm.k, rm.a, count(en.k) AS deg FROM rm LEFT JOIN en ON en.a = rm.a AND en.k <= rm.k GROUP BY ALL),
rq AS (SELECT p.k, sum((p.deg - o.deg) * (p.deg - o.deg)) / 2 AS q FROM rd p JOIN en ON en.a = p.a AND en.k <= p.k JOIN rd o ON o.k = p.k AND o.a = en.b GROUP BY p.k),
sc AS (SELECT component, k, size, size / (coalesce(q, 0) + {EPS}) AS score FROM (SELECT k, count(*)::BIGINT AS size FROM rm GROUP BY k) LEFT JOIN rq USING (k) JOIN st USING (k) JOIN cc ON cc.node = u)"""


@query("energy_edge_best", _sql("SELECT component, round(score, 12) AS score, size, a AS node FROM sc JOIN (SELECT component, arg_max(k, (score, -k)) AS k FROM sc GROUP BY component) USING (component, k) JOIN rm USING (k)",
    _PEEL, _CC, _STEPS))
def energy_edge_best(spark, d):
    return snapshots.best_by_edge(vertices(spark, d), edges(spark, d), EPS).withColumn("score", F.round("score", 12))


@query("stream_peaks", _sql(_PEAK_ROWS, _SNAP, _CC, _PEAK))
def stream_peaks(spark, d):
    """The peaks again, from a stream over the written snapshots that runs until all are read."""
    s = snaps(spark, d)
    name = f"peaks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    s.write.parquet(path)
    stream = spark.readStream.schema(s.schema).parquet(path)
    q = peaks.track_peaks(stream, EPS).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("component", "nc", F.round("score", 12).alias("score"))


@query("stream_peaks_keyed", _sql(_PEAK_ROWS, _SNAP, _CC, _PEAK))
def stream_peaks_keyed(spark, d):
    """The peaks from a stream in several files, one to a batch, by keyed state, written batch by batch."""
    s = snaps(spark, d)
    path = f"{shared_dir(spark)}/peaks_{uuid.uuid4().hex}"
    s.repartition(4, "sid").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    peaks.follow(stream, EPS, f"{path}/out", f"{path}/state").awaitTermination()
    return peaks.latest(spark, f"{path}/out").select("component", "nc", F.round("score", 12).alias("score"))


# distances


_BFS = """bf(node, dist) AS (SELECT min(node), 0 FROM vtx UNION SELECT d, dist + 1 FROM bf JOIN sym ON s = node WHERE dist < 30),
bd AS MATERIALIZED (SELECT node, min(dist) AS dist FROM bf GROUP BY node)"""


@query("bfs_distance", _sql("SELECT vtx.node, coalesce(dist, -1)::BIGINT AS dist FROM vtx LEFT JOIN bd USING (node)", _BFS))
def bfs_distance(spark, d):
    v = vertices(spark, d)
    return paths.bfs(v, edges(spark, d), v.agg(F.min("node").alias("node")))


@query("diameter_2sweep", _sql("SELECT dist::BIGINT AS diameter, a, node AS b FROM be, fa ORDER BY dist DESC, node LIMIT 1", _BFS,
    "fa AS MATERIALIZED (SELECT node AS a FROM bd ORDER BY dist DESC, node LIMIT 1)", "bg(node, dist) AS (SELECT a, 0 FROM fa UNION SELECT d, dist + 1 FROM bg JOIN sym ON s = node WHERE dist < 30)",
    "be AS (SELECT node, min(dist) AS dist FROM bg GROUP BY node)"))
def diameter_2sweep(spark, d):
    return paths.two_sweep_diameter(vertices(spark, d), weighted(spark, d))  # writes the edges itself


@query("nearest_seed_owner", _sql("SELECT f.node, dist, f.owner FROM (SELECT dist, unnest(front) AS f FROM ow)", _DEG, """tk AS MATERIALIZED (SELECT node FROM dg ORDER BY deg DESC, node LIMIT 5),
ow(dist, front, done) AS (SELECT 0::BIGINT, (SELECT list({'node': node, 'owner': node}) FROM tk), (SELECT list(node) FROM tk) UNION ALL
 SELECT dist + 1, nx, list_concat(done, list_transform(nx, lambda x: x.node)) FROM (SELECT dist, done, (SELECT list({'node': d, 'owner': o}) FROM
  (SELECT sym.d, min(a.f.owner) AS o FROM unnest(front) a(f) JOIN sym ON sym.s = a.f.node WHERE NOT list_contains(done, sym.d) GROUP BY sym.d)) AS nx FROM ow) WHERE len(nx) > 0)"""))  # fmt: skip
def nearest_seed_owner(spark, d):
    """Every vertex that the seeds reach, however far."""
    return _nearest(spark, d)


def _nearest(spark, d, max_hops: int | None = None) -> DataFrame:
    e = edges(spark, d)
    seeds = graph.degree(vertices(spark, d), e).orderBy(F.desc("deg"), "node").limit(5).select("node", F.col("node").alias("owner"))
    return paths.owners(e, seeds, max_hops)


# partitions


@query("partition_pool_mean", _sql("SELECT cluster_id, round(avg(s_acctbal), 6) AS mean_value FROM part0 JOIN supplier ON s_suppkey = node GROUP BY cluster_id"))
def partition_pool_mean(spark, d):
    v = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), F.col("s_acctbal").alias("value"))
    return partitions.pool_scalar(classes(spark, d), v).withColumn("mean_value", F.round("mean_value", 6))


@query("embedding_prototypes", "SELECT label::BIGINT AS cluster_id, (i - 1)::INT AS j, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def embedding_prototypes(spark, d):
    e = _t(spark, d, "embeddings")
    part = e.select(F.col("vec_id").alias("node"), F.col("label").cast("bigint").alias("cluster_id"))
    out = partitions.pool_mean(part, e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")))
    return out.withColumn("value", F.round("value", 6))


_CE = "ce AS MATERIALIZED (SELECT least(a.cluster_id, b.cluster_id) AS cu, greatest(a.cluster_id, b.cluster_id) AS cv, count(*)::BIGINT AS weight FROM e JOIN part0 a ON a.node = src JOIN part0 b ON b.node = dst WHERE a.cluster_id <> b.cluster_id GROUP BY ALL)"
_CS = "cz AS MATERIALIZED (SELECT cluster_id, count(*)::BIGINT AS size FROM part0 GROUP BY cluster_id)"


@query("cluster_edges_weighted", _sql("SELECT * FROM ce", _CE))
def cluster_edges_weighted(spark, d):
    return partitions.cluster_edges(weighted(spark, d), classes(spark, d))


@query("cluster_pairs_both", _sql("SELECT cu, cv FROM ce UNION ALL SELECT cv, cu FROM ce", _CE))
def cluster_pairs_both(spark, d):
    return partitions.cluster_pairs(edges(spark, d), classes(spark, d), both=True)


@query("cluster_size_stats", _sql("SELECT count(*)::BIGINT AS clusters, min(size) AS min_size, quantile_disc(size, 0.5) AS median_size, round(avg(size), 9) AS mean_size, max(size) AS max_size, round(avg((size = 1)::INT), 9) AS singleton_rate FROM cz", _CS))
def cluster_size_stats(spark, d):
    return partitions.size_statistics(classes(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_size", "singleton_rate")})


@query("mask_small_clusters", _sql("SELECT cluster_id, CASE WHEN size >= 10 THEN size::DOUBLE ELSE 0 END AS value FROM cz", _CS))
def mask_small_clusters(spark, d):
    p = classes(spark, d)
    return partitions.mask_small(p, p.groupBy("cluster_id").agg(F.count(F.lit(1)).cast("double").alias("value")), 10)


@query("compress_partition_k", _sql("""SELECT node, CASE WHEN (SELECT max(cluster_id) FROM part0) < 5 THEN x.cluster_id ELSE (SELECT count(*) FROM kp WHERE kp.cluster_id < x.cluster_id) END AS cluster_id FROM
 (SELECT node, CASE WHEN cluster_id IN (FROM kp) THEN cluster_id ELSE coalesce(to_id, (SELECT max(cluster_id) FROM kp)) END AS cluster_id FROM part0 LEFT JOIN mv ON mv.cu = cluster_id) x""".replace("5", str(K)),
    _CE, _CS, f"kp AS MATERIALIZED (SELECT cluster_id FROM cz ORDER BY size DESC, cluster_id LIMIT {K})",
    "mv AS (SELECT cu, arg_max(cv, (weight, cv)) AS to_id FROM (SELECT cu, cv, weight FROM ce UNION ALL SELECT cv, cu, weight FROM ce) WHERE cv IN (FROM kp) GROUP BY cu)"))
def compress_partition_k(spark, d):
    return partitions.compress(edges(spark, d), classes(spark, d), K)


@query("topk_degree_partition", _sql("SELECT node, coalesce((SELECT k FROM tk WHERE tk.node = vtx.node), (SELECT min(k) FROM tk JOIN sym ON sym.d = tk.node WHERE sym.s = vtx.node), 0)::BIGINT AS cluster_id FROM vtx",
    _DEG, f"tk AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY deg DESC, node) - 1 AS k FROM dg QUALIFY k < {K})"))
def topk_degree_partition(spark, d):
    return partitions.top_degree(vertices(spark, d), edges(spark, d), K)


@query("merge_tiny_clusters_one_round", _sql("SELECT node, min(b) AS cluster_id FROM part0 JOIN mr ON mr.a = cluster_id GROUP BY node", _CE, _CS,
    "ty AS (SELECT cu, cv, weight, size FROM (SELECT cu, cv, weight FROM ce UNION ALL SELECT cv, cu, weight FROM ce) JOIN cz ON cz.cluster_id = cv WHERE cu IN (SELECT cluster_id FROM cz WHERE size < 10))",
    "hk AS MATERIALIZED (SELECT cu, arg_max(cv, (weight, size, -cv)) AS cv FROM ty GROUP BY cu)", "hs AS (SELECT cu AS s, cv AS d FROM hk UNION ALL SELECT cv, cu FROM hk)",
    "mr(a, b) AS (SELECT cluster_id, cluster_id FROM cz UNION SELECT a, d FROM mr JOIN hs ON s = b)"))
def merge_tiny_clusters_one_round(spark, d):
    return partitions.merge_tiny(edges(spark, d), classes(spark, d), 10, rounds=1)


@query("set_overlap_jaccard", """WITH s AS (SELECT DISTINCT substr(o_orderpriority, 1, 1)::BIGINT AS set_id, o_custkey AS node FROM orders), n AS (SELECT set_id, count(*) AS n FROM s GROUP BY set_id),
i AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS k FROM s x JOIN s y ON x.node = y.node AND x.set_id < y.set_id GROUP BY ALL)
SELECT a, b, round(k / (p.n + q.n - k), 9) AS overlap FROM i JOIN n p ON p.set_id = a JOIN n q ON q.set_id = b""")
def set_overlap_jaccard(spark, d):
    s = _t(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("bigint").alias("set_id"), F.col("o_custkey").alias("node")).distinct()
    return partitions.jaccard(s).withColumn("overlap", F.round("overlap", 9))


_FAR = "list_transform(c, lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda i: (v[i] - x[i]) * (v[i] - x[i]))))"


@query("weighted_kmeans", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id AS node, embedding::DOUBLE[] AS v, (label + 1)::DOUBLE AS w FROM embeddings),
st(k, c) AS (SELECT 1, [arg_max(v, (w, -node))] FROM p UNION ALL
 SELECT k + 1, list_append(any_value(c), arg_max(v, (w * list_min({_FAR}), w, -node))) FROM st, p WHERE k < 10 GROUP BY k),
ll(r, c) AS (SELECT 0, c FROM st WHERE k = 10 UNION ALL
 SELECT r + 1, list(m ORDER BY j) FROM (SELECT r, j, list(m ORDER BY d) AS m FROM (SELECT r, j, d, sum(w * x) / sum(w) AS m FROM
  (SELECT r, list_position(near, list_min(near)) AS j, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x, w FROM (SELECT r, v, w, {_FAR} AS near FROM ll, p WHERE r < 30)) GROUP BY r, j, d) GROUP BY r, j) GROUP BY r)
SELECT node, (list_position(near, list_min(near)) - 1)::BIGINT AS cluster_id FROM (SELECT node, {_FAR} AS near FROM p, ll WHERE r = 30)""")
def weighted_kmeans(spark, d):
    e = _t(spark, d, "embeddings")
    return partitions.kmeans(e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), (F.col("label") + 1).alias("w")), 10, weight="w")


@query("stratified_split", """WITH l AS (SELECT vec_id AS node, label, md5(concat_ws(',', 42, vec_id)) AS h FROM embeddings),
t AS (SELECT node, true AS first FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, node) <= 20),
r AS (SELECT node, row_number() OVER (ORDER BY h, node) AS k FROM l WHERE node NOT IN (SELECT node FROM t))
SELECT node, CASE WHEN first THEN 'train' WHEN k <= 100 THEN 'val' WHEN k <= 300 THEN 'test' ELSE 'none' END AS role FROM l LEFT JOIN t USING (node) LEFT JOIN r USING (node)""")
def stratified_split(spark, d):
    e = _t(spark, d, "embeddings")
    return partitions.stratified_split(e.select(F.col("vec_id").alias("node"), "label"), 20, 100, 200)


# evaluation


_MAJ = "mj AS MATERIALIZED (SELECT cluster_id, arg_max(label, (n, -label)) AS pred FROM (SELECT cluster_id, label, count(*) AS n FROM part0 JOIN lab USING (node) GROUP BY ALL) GROUP BY cluster_id), pr AS MATERIALIZED (SELECT node, label, pred FROM lab JOIN part0 USING (node) JOIN mj USING (cluster_id))"
_F1 = "fc AS MATERIALIZED (SELECT r_regionkey::BIGINT AS label, (SELECT count(*) FROM pr WHERE pr.label = r_regionkey AND pred = r_regionkey) AS tp, (SELECT count(*) FROM pr WHERE pr.label = r_regionkey) AS t, (SELECT count(*) FROM pr WHERE pred = r_regionkey) AS p FROM region)"


def predictions(spark, d):
    return metrics.spread(classes(spark, d), regions(spark, d))


def _regions_of(spark, d):
    return _t(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("label"))


@query("majority_label", _sql("SELECT cluster_id, pred AS label FROM mj", _MAJ))
def majority_label(spark, d):
    return metrics.majority(classes(spark, d), regions(spark, d))


@query("majority_upper_bound", _sql("SELECT round(sum(top) / sum(n), 9) AS upper_bound FROM (SELECT cluster_id, max(n) AS top, sum(n) AS n FROM (SELECT cluster_id, label, count(*) AS n FROM part0 JOIN lab USING (node) GROUP BY ALL) GROUP BY cluster_id)"))
def majority_upper_bound(spark, d):
    return metrics.majority_bound(classes(spark, d), regions(spark, d)).withColumn("upper_bound", F.round("upper_bound", 9))


@query("accuracy", _sql("SELECT round(avg((label = pred)::INT), 9) AS accuracy, round(avg((label = pred)::INT), 9) AS covered_accuracy, 1.0::DOUBLE AS coverage FROM pr", _MAJ))
def accuracy(spark, d):
    return metrics.accuracy(predictions(spark, d)).withColumns({c: F.round(c, 9) for c in ("accuracy", "covered_accuracy", "coverage")})


@query("confusion", _sql("SELECT label, pred, count(*)::BIGINT AS n FROM pr GROUP BY ALL", _MAJ))
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query("macro_f1_all", _sql("SELECT round(avg(CASE WHEN t + p > 0 THEN 2.0 * tp / (t + p) ELSE 0 END), 9) AS macro_f1 FROM fc", _MAJ, _F1))
def macro_f1_all(spark, d):
    return metrics.macro_f1(predictions(spark, d), _regions_of(spark, d)).withColumn("macro_f1", F.round("macro_f1", 9))


@query("macro_f1_present", _sql("SELECT round(avg(CASE WHEN t + p > 0 THEN 2.0 * tp / (t + p) ELSE 0 END), 9) AS macro_f1 FROM fc WHERE t > 0", _MAJ, _F1))
def macro_f1_present(spark, d):
    return metrics.macro_f1(predictions(spark, d), _regions_of(spark, d), present_only=True).withColumn("macro_f1", F.round("macro_f1", 9))


@query("planted_prf", _sql("SELECT round(h / nf, 9) AS precision, round(h / nt, 9) AS recall, round(2 * (h / nf) * (h / nt) / (h / nf + h / nt), 9) AS f1 FROM (SELECT (SELECT count(*) FROM rich) AS nf, (SELECT count(*) FROM lab WHERE label = 3) AS nt, (SELECT count(*) FROM lab WHERE label = 3 AND node IN (FROM rich)) AS h)"))
def planted_prf(spark, d):
    return metrics.set_f1(rich(spark, d), regions(spark, d).where("label = 3")).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_BP = f"""bp AS MATERIALIZED (SELECT x AS node, arg_max(pos, (nc / (q + {EPS}), nc, pos)) AS cluster_id FROM mm JOIN sn USING (pos) GROUP BY x),
bm AS (SELECT cluster_id, arg_max(label, (n, -label)) AS pred FROM (SELECT cluster_id, label, count(*) AS n FROM bp JOIN lab USING (node) GROUP BY ALL) GROUP BY cluster_id)"""
_COMMON = "common AS (SELECT arg_max(label, (n, -label)) AS c FROM (SELECT label, count(*) AS n FROM lab GROUP BY label))"


@query("component_majority_eval", _sql("SELECT round(avg((label = coalesce(pred, c))::INT), 9) AS accuracy FROM lab LEFT JOIN bp USING (node) LEFT JOIN bm USING (cluster_id), common", _SNAP, _BP, _COMMON))
def component_majority_eval(spark, d):
    p = materialise(best_partition(spark, d), "partition")
    lab = regions(spark, d)
    pred = p.join(metrics.majority(p, lab).withColumnRenamed("label", "pred"), "cluster_id").select("node", "pred")
    return metrics.accuracy(metrics.fallback_majority(vertices(spark, d), pred, lab)).select(F.round("accuracy", 9).alias("accuracy"))


@query("nearest_seed_eval", _sql("""SELECT round(avg(coalesce((lab.label = s.label)::INT, 0)), 9) AS accuracy, round(avg((lab.label = s.label)::INT), 9) AS covered_accuracy, round(avg((s.label IS NOT NULL)::INT), 9) AS coverage
FROM lab LEFT JOIN (SELECT node, min(owner) AS owner FROM ow WHERE (node, dist) IN (SELECT node, min(dist) FROM ow GROUP BY node) GROUP BY node) n USING (node) LEFT JOIN lab s ON s.node = n.owner""",
    _DEG, "ow(node, dist, owner) AS (SELECT node, 0, node FROM (SELECT node FROM dg ORDER BY deg DESC, node LIMIT 5) UNION SELECT d, dist + 1, owner FROM ow JOIN sym ON s = node WHERE dist < 2)"))
def nearest_seed_eval(spark, d):
    lab = regions(spark, d)
    near = _nearest(spark, d, 2).join(lab.select(F.col("node").alias("owner"), F.col("label").alias("pred")), "owner").select("node", "pred")
    a = metrics.accuracy(lab.join(near, "node", "left"))
    return a.select(*(F.round(c, 9).alias(c) for c in ("accuracy", "covered_accuracy", "coverage")))


@query("eps_alpha_sweep", _sql(f"SELECT eps, alpha, round(max(nc * (sum_deg / nc - alpha * sqrt(q + eps))), 6) AS best_score FROM sn, (SELECT unnest({SWEEP})::DOUBLE AS eps), (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS alpha) GROUP BY ALL", _SNAP))
def eps_alpha_sweep(spark, d):
    s = snapshots.snapshots(vertices(spark, d), edges(spark, d))
    return snapshots.calibrated_sweep(s, SWEEP, [0.01, 0.1, 1.0]).withColumn("best_score", F.round("best_score", 6))


@query("at_best_parameter", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_discount = (SELECT l_discount FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, 1 LIMIT 1) GROUP BY 1")
def at_best_parameter(spark, d):
    return stats.at_best_parameter(_t(spark, d, "lineitem"), "l_discount", "l_returnflag", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("planted_sweep")
def planted_sweep(spark, d):
    """Accuracy of the methods on planted graphs of as many vertices as there are suppliers, and sixty."""
    return generate.sweep(spark, 60 + vertices(spark, d).count(), [20, 30], [0.8], [0.02, 0.05], [42, 43], eps=1e3).drop("ms")


# reports


@query("group_mean_sd", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS sd, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def group_mean_sd(spark, d):
    return stats.mean_sd(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query("pop_sd", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def pop_sd(spark, d):
    return stats.mean_sd(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", population=True).withColumns({c: F.round(c, 4) for c in ("mean", "sd")})


@query("lsq_origin", "SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS slope FROM lineitem")
def lsq_origin(spark, d):
    return stats.through_origin(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("slope", F.round("slope", 6))


@query("paired_t", "SELECT count(d)::BIGINT AS n, round(avg(d), 9) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, round(avg(d) / stddev_pop(d), 9) AS cohen_d FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def paired_t(spark, d):
    t = stats.paired_t(_t(spark, d, "lineitem"), "l_discount", "l_tax").drop("p_value")
    return t.withColumns({"mean_diff": F.round("mean_diff", 9), "t": F.round("t", 6), "cohen_d": F.round("cohen_d", 9)})


@query("paired_t_by_group", """WITH g AS (SELECT l_suppkey, count(*) AS n, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM (SELECT l_suppkey, l_discount - (l_tax + 0.01) AS x FROM lineitem) GROUP BY 1),
a AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS o FROM g),
s AS (SELECT *, list_sum(list_transform(range(0, (v - v % 2) // 2), lambda j: CASE WHEN v % 2 = 1
  THEN exp(lgamma(j + 1.0) + 0.5 * ln(pi()) - ln(2) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(o))) ELSE exp(lgamma(j + 0.5) - 0.5 * ln(pi()) - lgamma(j + 1.0) + 2 * j * ln(cos(o))) END)) AS q FROM a)
SELECT l_suppkey, n, round(t, 6) AS t, round(CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (o + sin(o) * coalesce(q, 0)) ELSE 1 - sin(o) * q END, 9) AS p_value FROM s""")
def paired_t_by_group(spark, d):
    """p as a column; the SQL sums the finite series that whole degrees of freedom have."""
    rows = _t(spark, d, "lineitem").withColumn("other", F.col("l_tax") + 0.01)
    t = stats.paired_t(rows, "l_discount", "other", ["l_suppkey"])
    return t.select("l_suppkey", "n", F.round("t", 6).alias("t"), F.round("p_value", 9).alias("p_value"))


_COLUMNS = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(v)::BIGINT AS filled, count(x)::BIGINT AS "numeric", count(DISTINCT v)::BIGINT AS distinct_values, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
round(coalesce(stddev_samp(x), CASE WHEN count(x) > 0 THEN 0.0 END), 4) AS sd, round(min(x), 4) AS min, round(max(x), 4) AS max, round(sum(x), 4) AS sum
FROM (SELECT nullif(trim({c}::VARCHAR), '') AS v, try_cast(trim({c}::VARCHAR) AS DOUBLE) AS x FROM customer)"""
    for c in _COLUMNS
)


@query("column_profile", _PROFILE)
def column_profile(spark, d):
    return stats.profile(_t(spark, d, "customer"), list(_COLUMNS), digits=4)


@query("telling_columns", """WITH m AS (SELECT l_returnflag, "column", round(avg(x), 3) AS mean FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount', 'l_tax']) AS "column", unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) GROUP BY ALL)
SELECT * FROM m WHERE "column" IN (SELECT "column" FROM m GROUP BY 1 HAVING count(DISTINCT mean) > 1)""")
def telling_columns(spark, d):
    return stats.telling_columns(_t(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query("value_distribution", "SELECT p_brand AS value, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_distribution(spark, d):
    return stats.distribution(_t(spark, d, "part"), "p_brand").withColumn("percent", F.round("percent", 9))


@query("upper_median", """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT max(CASE WHEN k = least(floor(0.5 * n), n - 1) THEN v END) AS p50, max(CASE WHEN k = least(floor(0.9 * n), n - 1) THEN v END) AS p90 FROM r""")
def upper_median(spark, d):
    return stats.pick(_t(spark, d, "orders"), "o_totalprice", {"p50": 0.5, "p90": 0.9})


@query("truncated_mean", "SELECT c_mktsegment, floor(sum(floor(c_acctbal)) / count(c_acctbal))::BIGINT AS mean FROM customer GROUP BY 1")
def truncated_mean(spark, d):
    return stats.truncated_mean(_t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("argmax_param", "SELECT l_discount, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, 1 LIMIT 1")
def argmax_param(spark, d):
    return stats.best_parameter(_t(spark, d, "lineitem"), "l_discount", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("theory_curve", _sql("SELECT node, deg, round((node + 2 + deg) * ln(node + 2) + deg * 3, 6) AS theory FROM dg", _DEG))
def theory_curve(spark, d):
    deg = graph.degree(vertices(spark, d), weighted(spark, d))
    return deg.select("node", "deg", F.round(stats.theory(F.col("node") + 2, F.col("deg"), F.lit(3)), 6).alias("theory"))


# features


@query("row_normalize", "SELECT vec_id AS node, (i - 1)::INT AS j, round(embedding[i]::DOUBLE / greatest(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 1e-12), 4) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS embedding FROM embeddings), range(1, 65) t(i)")
def row_normalize(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", F.abs).alias("vector"))
    return features.row_normalise(e).select("node", F.posexplode("vector").alias("j", "x")).withColumn("x", F.round("x", 4))


@query("gcn_propagate_once", _sql("SELECT a.node, 0 AS j, round(sum(x.v / sqrt(b.deg + 1)) / sqrt(max(a.deg) + 1), 6) AS x FROM (SELECT s AS node, d AS o FROM sym UNION ALL SELECT node, node FROM vtx) p JOIN dg a ON a.node = p.node JOIN dg b ON b.node = p.o JOIN (SELECT s_suppkey AS node, s_acctbal AS v FROM supplier) x ON x.node = p.o GROUP BY a.node", _DEG))
def gcn_propagate_once(spark, d):
    v = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), F.lit(0).alias("j"), F.col("s_acctbal").alias("x"))
    return features.propagate(vertices(spark, d), edges(spark, d), v).withColumn("x", F.round("x", 6))


_VARIANTS = {"x2": "s_acctbal * CASE WHEN rich THEN 2 ELSE 1 END", "x5": "s_acctbal * CASE WHEN rich THEN 5 ELSE 1 END", "plus1": "s_acctbal + rich::INT"}


@query("feature_variants", " UNION ALL ".join(f"SELECT '{how}' AS how, s_suppkey::BIGINT AS node, {x} AS x FROM (SELECT *, s_acctbal > 0 AS rich FROM supplier)" for how, x in _VARIANTS.items()))
def feature_variants(spark, d):
    f = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), F.array("s_acctbal").alias("vector"))
    made = [features.integrate(f, rich(spark, d), how).select(F.lit(how).alias("how"), "node", F.col("vector")[0].alias("x")) for how in _VARIANTS]
    return reduce(DataFrame.unionByName, made)


@query("virtual_edges", _sql("SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT src, dst, 1 AS n FROM e UNION ALL SELECT a.node, b.node, 3 FROM rich a JOIN rich b ON a.node < b.node) GROUP BY src, dst"))
def virtual_edges(spark, d):
    """Three more edges for each pair of the chosen set, counted with those of the graph."""
    return features.virtual_weights(edges(spark, d), rich(spark, d))


@query("feature_integration", _sql("SELECT node, (i - 1)::INT AS j, CASE WHEN i = 1 THEN s_acctbal ELSE (s_acctbal > 0)::INT::DOUBLE END AS x FROM (SELECT s_suppkey::BIGINT AS node, s_acctbal FROM supplier), range(1, 3) t(i)"))
def feature_integration(spark, d):
    f = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("node"), F.array("s_acctbal").alias("vector"))
    return features.integrate(f, rich(spark, d), "flag").select("node", F.posexplode("vector").alias("j", "x"))


@query("gcn_train")
def gcn_train(spark, d):
    s = _t(spark, d, "supplier")
    f = s.select(F.col("s_suppkey").cast("bigint").alias("node"), F.array(F.col("s_acctbal") / 10000, (F.col("s_acctbal") > 0).cast("double"), F.lit(1.0)).alias("vector"))
    lab = regions(spark, d)
    return features.gcn(vertices(spark, d), edges(spark, d), f, lab, partitions.stratified_split(lab, 8, 20, 20), rounds=60)


def _network(spark, d, clusters):
    s = _t(spark, d, "supplier")
    f = s.select(F.col("s_suppkey").cast("bigint").alias("node"), F.array(F.col("s_acctbal") / 10000, (F.col("s_acctbal") > 0).cast("double"), F.lit(1.0)).alias("vector"))
    lab = regions(spark, d)
    return networks.train(vertices(spark, d), edges(spark, d), f, lab, partitions.stratified_split(lab, 8, 20, 20), clusters, hidden=8, rounds=3)[0]


@query("seeded_pool_train")
def seeded_pool_train(spark, d):
    """Three steps of the network that pools by given clusters; its losses are tested against numeric gradients."""
    return _network(spark, d, classes(spark, d))


@query("topk_pool_train")
def topk_pool_train(spark, d):
    return _network(spark, d, 10)


@query("planted_generator")
def planted_generator(spark, d):
    """A planted graph with as many vertices as there are suppliers, and ten more."""
    return generate.planted_clusters(spark, 10 + vertices(spark, d).count(), clusters=2, share=0.4, p_intra=0.5, p_inter=0.02)
