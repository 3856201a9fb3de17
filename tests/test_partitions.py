"""Partitions, metrics, statistics, features and generators."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import metrics, stats
from graphloom.functions.storage import materialise
from graphloom.operators import features, partitions, snapshots
from graphloom.plans import generate


def part(spark, rows):
    return spark.createDataFrame(rows, "node bigint, cluster_id bigint")


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_compress_and_merge(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)], "src bigint, dst bigint")
    p = part(spark, [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 3)])
    assert as_dict(partitions.compress(e, p, 2), "node", "cluster_id") == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}  # what stays is numbered anew
    merged = as_dict(partitions.merge_tiny(e, p, 2, rounds=1), "node", "cluster_id")
    assert merged[3] in (0, 1) and merged[3] == merged[0] and merged[6] == 3


def test_last_cluster_wins_and_singletons(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 0)], "node bigint, cluster_id bigint, ordinal bigint")
    got = partitions.last_wins(rows)
    assert as_dict(got, "node", "cluster_id") == {1: 6, 2: 5}
    v = spark.range(4).withColumnRenamed("id", "node")
    full = partitions.with_singletons(v, got)
    assert as_dict(full, "node", "cluster_id") == {1: 6, 2: 5, 0: 7, 3: 8}
    partitions.check_cover(v, full)
    with pytest.raises(ValueError):
        partitions.check_cover(v, got)


def test_greedy_selection(spark):
    rows = [(1, 1, n) for n in (1, 2, 3)] + [(2, 2, n) for n in (1, 2, 3, 4)] + [(3, 3, n) for n in (7, 8)] + [(4, 4, n) for n in (9,)]
    c = spark.createDataFrame(rows, "rank bigint, set_id bigint, node bigint")
    picked = partitions.select_seeds(c, 20, overlap=0.7, coverage=0.25)
    assert {r["set_id"] for r in picked.collect()} == {1, 3}
    assert {(r["a"], r["b"]): r["overlap"] for r in partitions.jaccard(c.select("set_id", "node")).collect()} == {(1, 2): 0.75}


def test_selection_goes_on_until_covered(spark, monkeypatch):
    from graphloom.plans import queries, seeds

    # of 4000 vertices 500 in complete graphs of 5, whose nested snapshots fill the head of the list
    pairs = [(5 * c + i, 5 * c + j) for c in range(100) for i in range(5) for j in range(i + 1, 5)]
    v, e = spark.range(4_000).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "src bigint, dst bigint")
    s = snapshots.snapshots(v, e)
    monkeypatch.setattr(queries, "vertices", lambda *_: v)
    monkeypatch.setattr(queries, "snaps", lambda *_: s)
    got = seeds.nms_coverage_select(spark, "").toPandas()
    assert got["node"].nunique() >= 600  # 15 %

    every = materialise(snapshots.ranked(s, snapshots.score(1e4), 4_000), "ranked")
    m = snapshots.members(s, every).join(every.select("component", "sid", "rank"), ["component", "sid"])
    for coverage, overlap in ((0.15, 0.8), (0.3, 0.5)):
        want = partitions.select_seeds(m.select("rank", F.col("rank").alias("set_id"), "node"), 4_000, overlap, coverage)
        got = partitions.select_snapshots(s, snapshots.score(1e4), 4_000, overlap, coverage)
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_kmeans_finds_clear_clusters(spark):
    pts = [(i, [float(i % 3) * 10 + (i % 7) * 0.01, 1.0]) for i in range(60)]
    df = spark.createDataFrame(pts, "node bigint, vector array<double>")
    got = as_dict(partitions.kmeans(df, 3), "node", "cluster_id")
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in range(60))


def test_kmeans_starts_from_all_points(spark):
    # clusters in the order of the ids: the first 1500 points are one cluster
    pts = [(i, [max(0, i // 300 - 4) * 50.0 + (i % 7) * 0.01, 1.0]) for i in range(3_000)]
    df = spark.createDataFrame(pts, "node bigint, vector array<double>").repartition(3)
    got = as_dict(partitions.kmeans(df, 6), "node", "cluster_id")
    groups = {}
    for i, (x, _) in pts:
        groups.setdefault(round(x / 50), set()).add(got[i])
    assert len(groups) == 6 and sorted(map(len, groups.values())) == [1] * 6 and len(set.union(*groups.values())) == 6


def test_split_is_stratified(spark):
    labels = spark.createDataFrame([(i, i % 4) for i in range(100)], "node bigint, label bigint")
    s = partitions.stratified_split(labels, 5, 10, 20).join(labels, "node")
    assert as_dict(s.groupBy("role").count(), "role", "count") == {"train": 20, "val": 10, "test": 20, "none": 50}
    assert {r["count"] for r in s.where("role = 'train'").groupBy("label").count().collect()} == {5}


def test_metrics(spark):
    p = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 2, None)], "node bigint, label bigint, pred bigint")
    a = metrics.accuracy(p).first()
    assert (a["accuracy"], a["covered_accuracy"], a["coverage"]) == (0.5, pytest.approx(2 / 3), 0.75)
    classes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "label bigint")
    assert metrics.macro_f1(p, classes).first()[0] == pytest.approx((2 / 3 + 2 / 3) / 4)
    assert metrics.macro_f1(p, classes, present_only=True).first()[0] == pytest.approx((2 / 3 + 2 / 3) / 3)
    node = lambda xs: spark.createDataFrame([(x,) for x in xs], "node bigint")
    assert tuple(metrics.set_f1(node([1, 2, 3]), node([2, 3, 4, 5])).first()) == (pytest.approx(2 / 3), 0.5, pytest.approx(4 / 7))
    assert tuple(metrics.set_f1(node([1]), node([2])).first()) == (0.0, 0.0, 0.0)


def test_paired_t_and_p(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.7), (4.0, 3.1)], "a double, b double")
    r = stats.paired_t(df, "a", "b").first()
    d = [0.5, 1.0, 0.3, 0.9]
    mean = sum(d) / 4
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 3)
    assert r["t"] == pytest.approx(mean / (sd / 2))
    assert stats.p_value(2.0, 11) == pytest.approx(0.0734, abs=1e-4)
    assert stats.p_value(0.0, 5) == 1.0


def test_p_as_a_column(spark):
    cases = [(t, n) for n in (2, 3, 5, 6, 30, 31, 1000, 200_000) for t in (0.0, 1e-9, -0.3, 1.0, 1.7, -2.5, 6.0, 40.0)]
    df = spark.createDataFrame([*cases, (1.0, 1), (None, 5), (float("inf"), 5), (1.0, None)], "t double, n bigint")
    got = {(r["t"], r["n"]): r["p"] for r in df.select("t", "n", stats.t_tail(F.col("t"), F.col("n") - 1).alias("p")).collect()}
    for t, n in cases:
        want = stats.p_value(t, n)
        assert got[t, n] == pytest.approx(want, rel=2e-9, abs=1e-300), (t, n)
    assert got[1.0, 1] is None and got[None, 5] is None and got[1.0, None] is None and got[float("inf"), 5] == 0.0
    # half the mass of Cauchy's distribution lies within 1
    assert got[1.0, 2] == pytest.approx(0.5)
    rows = [("a", 1.0, 0.5), ("a", 2.0, 1.0), ("a", 3.0, 2.7), ("b", 1.0, 0.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0), ("d", None, 1.0)]
    by = {r["g"]: r for r in stats.paired_t(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert by["a"]["p_value"] == pytest.approx(stats.p_value(by["a"]["t"], 3)) and by["a"]["n"] == 3
    assert by["b"]["t"] is None and by["c"]["t"] is None and by["d"]["n"] == 0 and by["d"]["p_value"] is None


def test_profile_against_pandas(spark):
    rng = random.Random(4)
    frame = pd.DataFrame({"x": [rng.choice(["1", "2.5", " 7 ", "1e3", "", None, "no"]) for _ in range(999)], "y": [str(rng.gauss(0, 5)) for _ in range(999)], "z": [None] * 999})
    got = {r["column"]: r for r in stats.profile(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "x string, y string, z string"), digits=9).collect()}
    for c in ("x", "y"):
        v = frame[c][frame[c].notna() & (frame[c].str.strip() != "")]
        n = pd.to_numeric(v, errors="coerce").dropna()
        r = got[c]
        assert (r["filled"], r["distinct_values"], r["numeric"]) == (len(v), v.nunique(), len(n))
        assert [r[k] for k in ("mean", "median", "sd", "min", "max", "sum")] == pytest.approx([n.mean(), n.median(), n.std(), n.min(), n.max(), n.sum()], abs=1e-6)
    assert got["z"]["filled"] == got["z"]["distinct_values"] == 0 and got["z"]["median"] is None and got["z"]["sd"] is None


def test_profile_and_pick(spark):
    df = spark.createDataFrame([("1", "x"), ("2", ""), ("bad", "y"), (None, "x")], "a string, b string")
    got = {r["column"]: r for r in stats.profile(df).collect()}
    assert (got["a"]["filled"], got["a"]["numeric"], got["a"]["mean"], got["a"]["sd"]) == (3, 2, 1.5, pytest.approx(0.707107))
    assert (got["b"]["filled"], got["b"]["numeric"], got["b"]["distinct_values"]) == (3, 0, 2)
    n = spark.range(5)
    assert tuple(stats.pick(n, "id", {"m": 0.5, "p": 0.9, "top": 1.0}).first()) == (2, 4, 4)


def test_positions_by_range(spark):
    from graphloom.functions import ranks

    values = [5, -3, 12, 40, 41, 7, 1000]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    want = {v: k for k, v in enumerate(sorted(values), 1)}
    assert as_dict(ranks.number(df, "v", "k", first=1, width=10), "v", "k") == want
    counts = spark.createDataFrame([(float(v), 2) for v in values], "v double, n bigint")
    for rows in (100, 2):  # in one range and in several
        assert as_dict(ranks.running_count(counts, "v", "n", rows=rows), "v", "upto") == {v: 2 * k for v, k in want.items()}


def test_features(spark):
    v = spark.range(3).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(0, 1)], "src bigint, dst bigint")
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 0, 5.0)], "node bigint, j int, x double")
    assert as_dict(features.propagate(v, e, x), "node", "x") == {0: pytest.approx(2.0), 1: pytest.approx(2.0), 2: pytest.approx(5.0)}
    f = spark.createDataFrame([(0, [1.0, 3.0]), (1, [0.0, 0.0])], "node bigint, vector array<double>")
    assert as_dict(features.row_normalise(f), "node", "vector") == {0: [0.25, 0.75], 1: [0.0, 0.0]}
    chosen = spark.createDataFrame([(0,)], "node bigint")
    assert as_dict(features.integrate(f, chosen, "x5"), "node", "vector")[0] == [5.0, 15.0]
    assert features.virtual_edges(e, v).count() == 1 + 9


def test_network_learns_a_separable_graph(spark):
    n = 40
    v = spark.range(n).withColumnRenamed("id", "node")
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if a % 2 == b % 2 and (a + b) % 3 == 0]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    f = v.select("node", F.array((F.col("node") % 2).cast("double"), F.lit(1.0)).alias("vector"))
    labels = v.select("node", (F.col("node") % 2).alias("label"))
    out = features.gcn(v, e, f, labels, partitions.stratified_split(labels, 5, 10, 20), rounds=100)
    assert out.where("pred = label").count() >= 38


def test_generators(spark):
    e = generate.planted_clusters(spark, 400, clusters=4, share=0.4, p_intra=0.5, p_inter=0.01)
    inner = e.where("src < 160 AND dst < 160 AND floor(src / 40) = floor(dst / 40)").count()
    assert abs(inner - 4 * 40 * 39 / 2 * 0.5) < 200 and e.where("src >= dst").count() == 0
    assert e.distinct().count() == e.count() == generate.planted_clusters(spark, 400, clusters=4, share=0.4, p_intra=0.5, p_inter=0.01).count()
    assert generate.planted_set(spark, 50, 10, 1.0, 0.0).count() == 45
    sizes = generate.log_sizes(10_000, 1_000_000, 10)
    assert sizes == sorted(set(sizes)) and all(s % 1000 == 0 for s in sizes) and (sizes[0], sizes[-1]) == (10_000, 1_000_000)


def test_sweep_recovers_a_planted_set(spark):
    got = {r["method"]: r["f1"] for r in generate.sweep(spark, 120, [40], [0.8], [0.02], [1, 2], eps=1e3).collect()}
    assert got["size-over-energy"] > 0.5 and got["densest"] > 0.8 and set(got) == {"size-over-energy", "densest", "dense-suffix", "k-core"}


def test_numbers_within_ranges_of_sparse_ids(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import ranks

    ids = [r["x"] for r in spark.range(500).select(F.xxhash64("id").alias("x")).collect()]
    rows = spark.createDataFrame([(x,) for x in ids], "x bigint")
    want = {x: i + 1 for i, x in enumerate(sorted(ids))}
    for width in (7, 100, 1_000):
        assert {r["x"]: r["k"] for r in ranks.number(rows, "x", "k", first=1, width=width).collect()} == want
    assert ranks.number(rows.limit(0), "x", "k").count() == 0
