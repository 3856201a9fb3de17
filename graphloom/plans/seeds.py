"""The driver's queries on files in and out and on ranked seeds, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import metrics
from graphloom.functions.storage import materialise, shared_dir
from graphloom.operators import partitions, paths, seeds, snapshots
from graphloom.operators.components import connected_components
from graphloom.plans import queries as q
from graphloom.plans.queries import EPS, K, query
from graphloom.sources import readers, writers

SEED_EPS = [1e-6, 1e4]
HOPS = 2


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# files


@query("header_file_edges", q._sql("SELECT src, dst FROM e"))
def header_file_edges(spark, d):
    """Ids of such files start at 1, those of the graph at 0."""
    path, e = _path(spark, "header"), q.edges(spark, d)
    up = e.select(F.col("src") + 1, F.col("dst") + 1).toDF("src", "dst")
    writers.header_edge_list(up, q.vertices(spark, d).agg(F.max("node")).first()[0] + 1, path)
    return readers.header_edges(spark, path)[1].select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


@query("token_file_edges", q._sql("SELECT src, dst FROM e"))
def token_file_edges(spark, d):
    """The same from a file with one number a line, so that every pair breaks over two lines."""
    path, e = _path(spark, "tokens"), q.edges(spark, d)
    n, m = q.vertices(spark, d).agg(F.max("node")).first()[0] + 1, e.count()
    pairs = e.select(F.explode(F.array(*((F.col(c) + 1).cast("string") for c in ("src", "dst")))).alias("value"))
    writers.headed(F.explode(F.array(F.lit(str(n)), F.lit(str(m)))), pairs, path)
    return readers.header_edges(spark, path)[1].select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


@query("plain_file_edges", q._sql("SELECT src, dst FROM e"))
def plain_file_edges(spark, d):
    path = _path(spark, "plain")
    writers.edge_list(q.weighted(spark, d), path)
    return readers.plain_edges(spark, path)[1]


@query("reindexed_edges", q._sql("""SELECT a.k AS src, b.k AS dst FROM e JOIN ids a ON a.node = src JOIN ids b ON b.node = dst""",
    "ids AS (SELECT node, row_number() OVER (ORDER BY node)::BIGINT AS k FROM (SELECT DISTINCT s AS node FROM sym))"))
def reindexed_edges(spark, d):
    return writers.reindexed(q.edges(spark, d))[0]


_NAME = "'S' || lpad(s_suppkey::VARCHAR, 8, '0')"
_CITED = f"""ci AS MATERIALIZED (SELECT s_suppkey::BIGINT AS key, (row_number() OVER (ORDER BY {_NAME}) - 1)::BIGINT AS node, {_NAME} AS ext_id,
 (dense_rank() OVER (ORDER BY n_regionkey) - 1)::BIGINT AS label_id, (s_acctbal > 0)::INT AS flag FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def citations(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The supplier graph, written as a content and a citation file and read back."""
    content, cites = _path(spark, "content"), _path(spark, "cites")
    ext = lambda c: F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 8, "0"))
    s = q._t(spark, d, "supplier").withColumn("node", F.col("s_suppkey").cast("bigint")).join(q.regions(spark, d), "node")
    flags = [(F.col("s_acctbal") > x).cast("int") for x in (0, 5000)]
    s.select(F.concat_ws(" ", ext("node"), *flags, F.concat(F.lit("R"), "label"))).write.text(content)
    q.edges(spark, d).select(F.concat_ws(" ", ext("src"), ext("dst"))).write.text(cites)
    return readers.citation_graph(spark, content, cites)


@query("citation_file_vertices", q._sql("SELECT node, ext_id, label_id, flag::DOUBLE AS flag FROM ci", _CITED))
def citation_file_vertices(spark, d):
    g = citations(spark, d)
    flag = g["features"].select("node", F.col("vector")[0].cast("double").alias("flag"))
    return g["vertices"].join(flag, "node").select("node", "ext_id", "label_id", "flag")


@query("citation_file_edges", q._sql("SELECT a.node AS src, b.node AS dst FROM e JOIN ci a ON a.key = src JOIN ci b ON b.key = dst", _CITED))
def citation_file_edges(spark, d):
    return citations(spark, d)["edges"]


@query("cluster_file", q._sql("SELECT node, cluster_id, cluster_id / 2 AS score FROM part0"))
def cluster_file(spark, d):
    path, p = _path(spark, "clusters"), q.classes(spark, d)
    scores = p.select("cluster_id").distinct().withColumn("score", F.col("cluster_id") / 2)
    writers.clusters_json(writers.clusters(p, scores), path, {"by": "balance"})
    rows = readers.clusters_json(spark, path)
    return partitions.last_wins(rows).join(rows.select("node", "score"), "node").select("node", "cluster_id", "score")


@query("result_files", "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def result_files(spark, d):
    path, n = _path(spark, "results"), q._t(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderstatus").alias("status")).count()
    n = materialise(n, "results")
    for k in "12345":  # one file for each value of a parameter, as a benchmark writes them
        writers.results_csv(n.where(F.col("o_orderpriority").startswith(k)), f"{path}/out,by={k}.csv")
    back = readers.results_csv(spark, f"{path}/out,by=*.csv", r"by=(\d+)\.csv")
    back = back.where(F.col("o_orderpriority").startswith(F.col("parameter")))
    return back.select(F.col("o_orderpriority").alias("priority"), "status", F.col("count").cast("bigint").alias("n"))


@query("circular_layout", q._sql("SELECT node, round(cos(node * 2 * pi() / n), 6) + 0.0 AS x, round(sin(node * 2 * pi() / n), 6) + 0.0 AS y FROM vtx, (SELECT count(*) AS n FROM vtx)"))
def circular_layout(spark, d):
    v = q.vertices(spark, d)
    at = paths.circular_layout(v, v.count())
    return at.select("node", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x", "y")))


# ranked seeds

_PEAK_SETS = """np AS (SELECT pos, (row_number() OVER (ORDER BY component) - 1)::BIGINT AS cluster_id FROM pk),
ps AS MATERIALIZED (SELECT cluster_id, x AS node FROM np JOIN mm USING (pos)),
pc AS MATERIALIZED (SELECT cluster_id, node FROM ps UNION ALL
 SELECT (SELECT count(*) FROM np) + row_number() OVER (ORDER BY node) - 1, node FROM vtx WHERE node NOT IN (SELECT node FROM ps))"""


@query("citation_seeds_to_pools", q._sql("""SELECT cluster_id::BIGINT AS cluster_id, count(*)::BIGINT AS size, arg_max(label_id, (n, -label_id)) AS label, round(avg(flag), 9) AS mean_flag
FROM (SELECT cluster_id, flag, label_id, count(*) OVER (PARTITION BY cluster_id, label_id) AS n FROM pc JOIN ci ON key = pc.node) GROUP BY cluster_id""",
    q._SNAP, q._CC, q._PEAK, _PEAK_SETS, _CITED))
def citation_seeds_to_pools(spark, d):
    """Content and citations, snapshots, peaks and singletons, their JSON file, and the pooled clusters."""
    g = citations(spark, d)
    v, e = materialise(g["vertices"].select("node", "label_id"), "vertices"), materialise(g["edges"], "edges")
    snaps = materialise(snapshots.snapshots(v.select("node"), e), "snapshots")
    path = _path(spark, "peaks")
    writers.clusters_json(seeds.peak_clusters(v, snaps, EPS), path, {"mode": "peaks_per_component+singletons", "epsilon": str(EPS)})
    part = materialise(partitions.with_singletons(v, partitions.last_wins(readers.clusters_json(spark, path))), "part")
    flag = g["features"].select("node", F.col("vector")[0].cast("double").alias("value"))
    size = part.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    top = metrics.majority(part, v.select("node", F.col("label_id").alias("label")))
    pooled = partitions.pool_scalar(part, flag).withColumnRenamed("mean_value", "mean_flag")
    return _rounded(size.join(top, "cluster_id").join(pooled, "cluster_id"), 9, "mean_flag")


_LOW = """lowq AS MATERIALIZED (SELECT * FROM sn WHERE nc > 1 AND q <= (SELECT q FROM (SELECT q, row_number() OVER (ORDER BY q) - 1 AS r FROM sn),
 (SELECT least(i0 + greatest(50, floor(0.05 * (n - i0))), n - 1) AS cut FROM (SELECT count(*) AS n, count_if(q <= 0) AS i0 FROM sn) z) y WHERE r = cut))"""
_DIAMETER = """b1(pos, node, dist) AS (SELECT lowq.pos, min(x), 0 FROM lowq JOIN mm USING (pos) GROUP BY lowq.pos
 UNION SELECT b1.pos, ie.d, dist + 1 FROM b1 JOIN ie ON ie.pos = b1.pos AND ie.s = b1.node WHERE dist < 30),
f1 AS MATERIALIZED (SELECT pos, arg_max(node, (dist, -node)) AS node FROM (SELECT pos, node, min(dist) AS dist FROM b1 GROUP BY ALL) GROUP BY pos),
b2(pos, node, dist) AS (SELECT pos, node, 0 FROM f1 UNION SELECT b2.pos, ie.d, dist + 1 FROM b2 JOIN ie ON ie.pos = b2.pos AND ie.s = b2.node WHERE dist < 30),
dm AS MATERIALIZED (SELECT pos, max(dist)::DOUBLE AS alpha FROM (SELECT pos, node, min(dist) AS dist FROM b2 GROUP BY ALL) GROUP BY pos)"""


def _lambda2(sets: str, variant: str = "damped") -> str:
    """``l2(set_id, lambda2)`` of ``sets``, a query of set_id and node, by the same power iteration."""
    near = "len(adj[i]) * x[i] - coalesce(list_sum(list_transform(adj[i], lambda j: x[j])), 0)"
    damped = variant == "damped"
    step = f"x[i] - ({near}) / (dmax + 1)" if damped else f"(2 * dmax + 1) * x[i] - ({near})"
    rounds, floor = ("greatest(40, least(200, 20 + 2 * n))", "1e-3") if damped else ("30", "1e-12")
    lap = f"x[i] * ({near})"

    def unit(inner: str) -> str:
        centred = f"SELECT * EXCLUDE (y), list_transform(y, lambda v: v - list_avg(y)) AS z FROM ({inner})"
        return f"SELECT set_id, k, list_transform(z, lambda v: v / sqrt(list_sum(list_transform(z, lambda u: u * u)))) AS x FROM ({centred}) WHERE list_sum(list_transform(z, lambda u: u * u)) > 0"

    start = "SELECT set_id, 0 AS k, list_transform(range(1, n + 1), lambda i: sin(i * 12.9898) * 43758.5453 - floor(sin(i * 12.9898) * 43758.5453) - 0.5) AS y FROM lg WHERE n > 1"
    then = f"SELECT pw2.set_id, k + 1 AS k, list_transform(range(1, n + 1), lambda i: {step}) AS y FROM pw2 JOIN lg USING (set_id) WHERE k < {rounds}"
    return f"""l0 AS MATERIALIZED (SELECT set_id, node, row_number() OVER (PARTITION BY set_id ORDER BY node) AS i FROM ({sets})),
la AS (SELECT a.set_id, a.i, coalesce(list(b.i ORDER BY b.i) FILTER (WHERE b.i IS NOT NULL), []) AS nb FROM l0 a LEFT JOIN sym ON s = a.node LEFT JOIN l0 b ON b.node = d AND b.set_id = a.set_id GROUP BY ALL),
lg AS MATERIALIZED (SELECT set_id, count(*) AS n, list(nb ORDER BY i) AS adj, max(len(nb)) AS dmax FROM la GROUP BY set_id),
pw2(set_id, k, x) AS ({unit(start)} UNION ALL {unit(then)}),
l2 AS MATERIALIZED (SELECT lg.set_id, greatest({floor}, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: {lap})), 0)) AS lambda2
 FROM lg LEFT JOIN (SELECT set_id, arg_max(x, k) AS x FROM pw2 GROUP BY set_id) USING (set_id))"""


def _connectivity(spark, d, variant):
    e = q.edges(spark, d)
    parts = materialise(connected_components(q.vertices(spark, d), e).select(F.col("component").alias("set_id"), "node"), "sets")
    return _rounded(paths.lambda2(e, parts, variant), 6, "lambda2")


@query("set_lambda2_shift", q._sql("SELECT set_id, round(lambda2, 6) AS lambda2 FROM l2", q._CC, _lambda2("SELECT component AS set_id, node FROM cc", "shift")))
def set_lambda2_shift(spark, d):
    return _connectivity(spark, d, "shift")


@query("set_lambda2", q._sql("SELECT set_id, round(lambda2, 6) AS lambda2 FROM l2", q._CC, _lambda2("SELECT component AS set_id, node FROM cc")))
def set_lambda2(spark, d):
    return _connectivity(spark, d, "damped")


_CALIBRATED = "nc * (sum_deg / nc - alpha * sqrt(q + {eps}))"
_BEST = _CALIBRATED.format(eps="1e-6::DOUBLE")


@query("calibrated_best", q._sql(f"SELECT component, node, nc, alpha, round({_BEST}, 9) AS score FROM lowq JOIN dm USING (pos) JOIN cc USING (node) ORDER BY {_BEST} DESC, component, pos DESC LIMIT 50",
    q._SNAP, q._CC, _LOW, _DIAMETER))
def calibrated_best(spark, d):
    """Best snapshots by the calibrated score, alpha from two-sweep diameters of the low-energy candidates."""
    s = q.snaps(spark, d)
    c = seeds.candidates(s, q.edges(spark, d)).withColumn("score", snapshots.calibrated(F.col("alpha"), 1e-6))
    return _rounded(c.orderBy(F.desc("score"), "component", "sid").limit(50).select("component", "node", "nc", "alpha", "score"), 9, "score")


def _greedy(ranked: str) -> str:
    """``sl(cell, rank, node)``: the greedy selection from ``ranked``, a query of cell, rank and members ``m``."""
    overlap = "len(list_intersect(c.m, m)) / (len(c.m) + len(m) - len(list_intersect(c.m, m))) > 0.8"
    return f"""rk AS MATERIALIZED ({ranked}),
gs(cell, rank, chosen, covered) AS (SELECT DISTINCT cell, 0::BIGINT, []::STRUCT(rank BIGINT, m BIGINT[])[], []::BIGINT[] FROM rk UNION ALL
 SELECT cell, rank, CASE WHEN keep THEN list_append(chosen, {{'rank': rank, 'm': m}}) ELSE chosen END, CASE WHEN keep THEN list_distinct(list_concat(covered, m)) ELSE covered END
 FROM (SELECT gs.cell, rk.rank, rk.m, chosen, covered, len(list_filter(chosen, lambda c: {overlap})) = 0 AS keep FROM gs JOIN rk ON rk.cell = gs.cell AND rk.rank = gs.rank + 1
  WHERE len(covered) = 0 OR len(covered) < 0.15 * (SELECT count(*) FROM vtx))),
sl AS MATERIALIZED (SELECT cell, c.rank AS rank, unnest(c.m) AS node FROM (SELECT cell, unnest(arg_max(chosen, rank)) AS c FROM gs GROUP BY cell))"""


_MEMBERS = "ml AS MATERIALIZED (SELECT pos, list(x ORDER BY x) AS m FROM mm GROUP BY pos)"
_NMS = _greedy(f"SELECT 0 AS cell, row_number() OVER (ORDER BY nc / (q + {EPS}) DESC, component, pos DESC) AS rank, m FROM sn JOIN cc USING (node) JOIN ml USING (pos)")


@query("nms_coverage_select", q._sql("SELECT rank, rank AS set_id, node FROM sl", q._SNAP, q._CC, _MEMBERS, _NMS))
def nms_coverage_select(spark, d):
    return partitions.select_snapshots(q.snaps(spark, d), snapshots.score(EPS), q.vertices(spark, d).count())


def _evaluated(hops: int) -> str:
    """``ev``: the scores of each cell's seeds."""
    return f"""sj AS (SELECT cell, rank, arg_max(label, (n, -label)) AS pred FROM (SELECT cell, rank, label, count(*) AS n FROM sl JOIN lab USING (node) GROUP BY ALL) GROUP BY ALL),
so(cell, node, dist, owner) AS (SELECT cell, node, 0, min(rank) FROM sl GROUP BY ALL UNION SELECT cell, d, dist + 1, owner FROM so JOIN sym ON s = node WHERE dist < {hops}),
sw AS (SELECT cell, node, min(dist) AS dist, arg_min(owner, (dist, owner)) AS rank FROM so GROUP BY ALL),
sp AS MATERIALIZED (SELECT x.cell, lab.node, label, coalesce(pred, c) AS pred, dist FROM (SELECT DISTINCT cell FROM sl) x CROSS JOIN lab CROSS JOIN common
 LEFT JOIN sw ON sw.cell = x.cell AND sw.node = lab.node LEFT JOIN sj ON sj.cell = x.cell AND sj.rank = sw.rank),
sf1 AS (SELECT cell, avg(CASE WHEN t + p > 0 THEN 2.0 * tp / (t + p) ELSE 0 END) AS macro_f1 FROM (SELECT cell, r_regionkey,
 count_if(label = r_regionkey AND pred = r_regionkey) AS tp, count_if(label = r_regionkey) AS t, count_if(pred = r_regionkey) AS p FROM sp CROSS JOIN region GROUP BY ALL) GROUP BY cell),
ev AS (SELECT cell, (SELECT count(DISTINCT rank) FROM sl WHERE sl.cell = sp.cell)::BIGINT AS seeds, round(avg((label = pred)::INT), 9) AS accuracy, round(avg((dist IS NOT NULL AND dist = 0)::INT), 9) AS coverage,
 round(avg((dist IS NOT NULL)::INT), 9) AS assigned, round(coalesce(avg((label = pred)::INT) FILTER (WHERE dist = 0), 0), 9) AS covered_accuracy, round(any_value(macro_f1), 9) AS macro_f1 FROM sp JOIN sf1 USING (cell) GROUP BY cell)"""


_SCORES = ("accuracy", "coverage", "assigned", "covered_accuracy", "macro_f1")


def _seed_eval(spark, d, hops):
    v, e = q.vertices(spark, d), q.edges(spark, d)
    s = materialise(snapshots.snapshots(v, e), "snapshots")
    chosen = materialise(partitions.select_snapshots(s, snapshots.score(EPS), v.count()), "seeds")
    return _rounded(seeds.evaluate(v, e, chosen, q.regions(spark, d), q._regions_of(spark, d), hops), 9, *_SCORES)


_EV = "SELECT * EXCLUDE (cell) FROM ev"


@query("ranked_seed_majority_eval", q._sql(_EV, q._SNAP, q._CC, _MEMBERS, _NMS, q._COMMON, _evaluated(0)))
def ranked_seed_majority_eval(spark, d):
    return _seed_eval(spark, d, 0)


@query("ranked_seed_nearest_eval", q._sql(_EV, q._SNAP, q._CC, _MEMBERS, _NMS, q._COMMON, _evaluated(HOPS)))
def ranked_seed_nearest_eval(spark, d):
    return _seed_eval(spark, d, HOPS)


_CELLS = f"""al AS MATERIALIZED (SELECT 'diameter' AS kind, pos, alpha FROM dm UNION ALL SELECT 'lambda2', set_id, 1 / sqrt(lambda2) FROM l2),
ga AS MATERIALIZED (SELECT kind || ' ' || eps AS cell, kind, eps FROM (VALUES ('diameter'), ('lambda2')) a(kind), (SELECT unnest({SEED_EPS})::DOUBLE AS eps))"""
_SWEPT = _greedy(f"""SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY {_CALIBRATED.format(eps='eps')} DESC, component, pos DESC) AS rank, m
 FROM ga JOIN al USING (kind) JOIN lowq USING (pos) JOIN cc USING (node) JOIN ml USING (pos)""")


@query("seed_sweep", q._sql("SELECT eps, kind AS alpha, ev.* EXCLUDE (cell) FROM ev JOIN ga USING (cell)", q._SNAP, q._CC, _LOW, _DIAMETER,
    _lambda2("SELECT mm.pos AS set_id, x AS node FROM mm JOIN lowq USING (pos)"), _MEMBERS, _CELLS, _SWEPT, q._COMMON, _evaluated(HOPS)))
def seed_sweep(spark, d):
    """Epsilon by kind of alpha, with each candidate's own alpha: seeds chosen to the coverage, all five scores."""
    v, e = q.vertices(spark, d), q.edges(spark, d)
    s = materialise(snapshots.snapshots(v, e), "snapshots")
    return _rounded(seeds.sweep(s, v, e, q.regions(spark, d), q._regions_of(spark, d), SEED_EPS, max_hops=HOPS), 9, *_SCORES)


@query("seed_text_file", q._sql(f"""SELECT CASE i WHEN 1 THEN printf('# seed %d, score=%.6f', rank - 1, nc / (q + {EPS})) ELSE array_to_string(m, ' ') END AS value
FROM (SELECT row_number() OVER (ORDER BY nc / (q + {EPS}) DESC, component, pos DESC) AS rank, nc, q, m FROM sn JOIN cc USING (node) JOIN ml USING (pos) QUALIFY rank <= {K}), range(1, 3) t(i)""",
    q._SNAP, q._CC, _MEMBERS))
def seed_text_file(spark, d):
    s, path = q.snaps(spark, d), _path(spark, "seeds")
    top = materialise(snapshots.ranked(s, snapshots.score(EPS), K).join(s.select("component", "sid", "node"), ["component", "sid"]), "top")
    held = seeds.members_by_maker(s, top).groupBy("set_id").agg(F.sort_array(F.collect_list("node")).alias("members"))
    writers.seeds_text(top.join(held, top["node"] == held["set_id"]).select("rank", "score", "members"), path)
    score = F.regexp_extract("value", r"^# seed \d+, score=(.*)$", 1).cast("double")  # written in full, compared to six digits
    head = F.concat(F.regexp_extract("value", "^(.*=)", 1), F.format_string("%.6f", score))
    return spark.read.text(path).select(F.when(F.col("value").startswith("#"), head).otherwise(F.col("value")).alias("value"))
