"""Graph work in rounds of joins, against plain loops over the same graphs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import ranks
from graphloom.operators import cores, partitions, paths, regions, snapshots
from graphloom.sources import readers


def core_numbers(n, pairs):
    near = {v: [] for v in range(n)}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    left, core, k = {v: len(near[v]) for v in near}, {}, 0
    while left:
        v = min(left, key=lambda x: (left[x], x))
        k = max(k, left.pop(v))
        core[v] = k
        for w in near[v]:
            if w in left:
                left[w] -= 1
    return core


def component_sizes(nodes, pairs):
    up = {v: v for v in nodes}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        if a in up and b in up:
            up[find(a)] = find(b)
    sizes = {}
    for v in nodes:
        sizes.setdefault(find(v), set()).add(v)
    return list(sizes.values())


def clustered(rng, n, p):
    """A denser quarter, repeated edges and a few loops."""
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p * (4 if a < n // 4 and b < n // 4 else 1)]
    return [*pairs, *pairs[: n // 10]]


def frames(spark, n, pairs):
    rows = [*pairs, (3, 3), (None, 1)]
    return spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(rows, "src bigint, dst bigint")


@pytest.mark.parametrize("n,p,size", [(70, 0.08, 30), (60, 0.2, 12), (40, 0.0, 5)])
def test_settled_regions_give_core_numbers(spark, n, p, size):
    """Sizes of 12 and 30 edge ends make hubs of the densest vertices."""
    pairs = clustered(random.Random(n), n, p)
    v, e = frames(spark, n, pairs)
    got = {r["node"]: r["core"] for r in cores.core_rounds(v, e, region_edges=size).collect()}
    assert got == core_numbers(n, pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 120_000
    order = np.random.default_rng(1).permutation(n)
    e = spark.createDataFrame(pd.DataFrame({"src": order[:-1], "dst": order[1:]}))
    rounds, keep = [0], cores.materialise

    def counted(df, name="step", *more):
        rounds[0] += name == "cores-lower"
        return keep(df, name, *more)

    monkeypatch.setattr(cores, "materialise", counted)
    got = cores.core_rounds(spark.range(n).withColumnRenamed("id", "node"), e, region_edges=20_000)
    assert [tuple(r) for r in got.groupBy("core").count().collect()] == [(1, n)] and rounds[0] < 20


def test_regions_hang_together_and_are_bounded(spark):
    n = 3_000
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i % 1000 != 999], "src bigint, dst bigint")
    w = spark.range(n).select(F.col("id").alias("node"), F.lit(2).alias("weight"))
    for finish in (10**6, 100):  # walked as it is, and contracted first
        got = regions.regions(w, e, 300, finish).toPandas()
        assert len(got) == n and got.groupby("region").size().max() <= 400
        cut = (got.sort_values("node")["region"].diff() != 0).sum()
        assert cut < 200  # most neighbours share a region
    assert regions.regions(w, e.limit(0), 300).count() == 0


@pytest.mark.parametrize("finish", [0, 10**6])
def test_core_forest(spark, monkeypatch, finish):
    monkeypatch.setattr(cores, "FINISH_EDGES", finish)
    n, rng = 60, random.Random(11)
    pairs = clustered(rng, n, 0.06)
    v, e = frames(spark, n, pairs)
    core = core_numbers(n, pairs)
    want = {k: component_sizes([x for x in core if core[x] >= k], pairs) for k in range(1, max(core.values()) + 1)}
    c = spark.createDataFrame(list(core.items()), "node bigint, core bigint")
    for r in cores.core_forest(c, e).collect():
        assert any(r["root"] in s and len(s) == r["size"] for s in want[r["k"]])
    assert {r["k"]: r["size"] for r in cores.largest_components(c, e).collect()} == {k: max(map(len, s)) for k, s in want.items()}
    best = max(k * len(s) for k in want for s in want[k])
    assert cores.rmc(c, e).first()["rmc"] == best
    members = cores.rmc_members(c, e).collect()
    k = members[0]["k"]
    assert k * len(members) == best and {r["node"] for r in members} in want[k]
    assert cores.rmc(c.limit(0), e.limit(0)).first()["rmc"] == 0 and cores.rmc_members(c.limit(0), e.limit(0)).count() == 0


def greedy(ranked, n, overlap, coverage):
    chosen, covered = [], set()
    for rank, s in ranked:
        if covered and len(covered) >= coverage * n:
            break
        if all(len(s & t) <= overlap * len(s | t) for _, t in chosen):
            chosen.append((rank, s))
            covered |= s
    return sorted((r, v) for r, s in chosen for v in s)


@pytest.mark.parametrize("overlap,coverage,finish", [(0.8, 0.9, 0), (0.5, 0.4, 0), (0.9, 2.0, 40), (0.8, 0.5, 10**6)])
def test_selection_in_rounds_is_the_scan(spark, monkeypatch, overlap, coverage, finish):
    monkeypatch.setattr(partitions, "FINISH_SETS", finish)
    n, rng = 90, random.Random(12)
    v, e = frames(spark, n, clustered(rng, n, 0.03))
    snaps = snapshots.snapshots(v, e.where("src <> dst")).cache()
    rows = [r.asDict() for r in snaps.collect()]
    value = snapshots.score(3.0)
    rows.sort(key=lambda r: (-(r["nc"] / (r["q"] + 3.0)), r["component"], r["sid"]))
    held = lambda r: {x["node"] for x in rows if x["component"] == r["component"] and r["tin"] <= x["tin"] <= r["tout"]}
    ranked = [(i, held(r)) for i, r in enumerate(rows, 1)]
    want = greedy(ranked, n, overlap, coverage)
    got = partitions.select_snapshots(snaps, value, n, overlap, coverage)
    assert sorted((r["rank"], r["node"]) for r in got.collect()) == want
    sets = spark.createDataFrame([(i, i, x) for i, s in ranked for x in s], "rank bigint, set_id bigint, node bigint")
    got = partitions.select_seeds(sets, n, overlap, coverage)
    assert sorted((r["rank"], r["node"]) for r in got.collect()) == want
    assert partitions.select_snapshots(snaps.limit(0), value, n).count() == 0 and partitions.select_seeds(sets.limit(0), n).count() == 0
    snaps.unpersist()


def test_best_above_a_deep_chain(spark):
    n = 500
    rows = [(0, s, 1000 + s, s + 1 if s + 1 < n else -1, s + 1, (s * 7919) % 501) for s in range(n)]
    snaps = spark.createDataFrame(rows, "component bigint, sid bigint, node bigint, parent bigint, nc bigint, q bigint")
    got = {r["sid"]: r["best"] for r in snapshots.best_above(snaps, F.col("q")).collect()}
    assert got == {s: max(r[5] for r in rows[s:]) for s in range(n)}


def test_places_in_any_order(spark):
    rng = random.Random(13)
    names = ["the/very/same/start/of/all/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(3_000)]
    frame = spark.createDataFrame([(x, rng.randint(-(2**62), 2**62)) for x in names], "name string, id bigint").repartition(7)
    got = [(r["name"], r["id"]) for r in ranks.placed(frame, "k", F.desc("name"), F.col("id"), first=1).orderBy("k").collect()]
    assert got == sorted(((r["name"], r["id"]) for r in frame.collect()), key=lambda x: ([-ord(c) for c in x[0]] + [0], x[1]))
    codes = {r["name"]: r["code"] for r in readers.dictionary(frame, "name").collect()}
    assert codes == {x: i for i, x in enumerate(sorted(set(names)))}
    assert ranks.placed(frame.limit(0), "k", F.col("id")).count() == 0


def test_pairs_that_break_over_lines(spark, tmp_path):
    rng = random.Random(14)
    pairs = [(rng.randint(0, 41), rng.randint(1, 40)) for _ in range(4_000)]
    tokens = ["40", "4000", *(str(x) for p in pairs for x in p), "1", "2", "x"]
    want = {(min(p), max(p)) for p in pairs if p[0] != p[1] and 1 <= p[0] <= 40}
    for seed in range(3):
        text, r = "\n \n", random.Random(seed)
        for t in tokens:
            text += t + r.choice([" ", "\n", "\t", " \n\n", "  "] if seed else ["\n"])
        path = tmp_path / f"t{seed}"
        path.write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        try:
            v, e = readers.header_edges(spark, str(path), first_m=True)
            assert {(r["src"], r["dst"]) for r in e.collect()} == want and v.count() == 40
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty").write_text("\n")
    v, e = readers.header_edges(spark, str(tmp_path / "empty"))
    assert v.count() == e.count() == 0


def hops(near, inside, start):
    dist, todo = {start: 0}, [start]
    for v in todo:
        for w in near[v]:
            if w in inside and w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    top = max(dist.values())
    return top, min(v for v in dist if dist[v] == top)


def test_diameters_of_many_sets_at_once(spark, monkeypatch):
    monkeypatch.setattr(paths, "LEVELS", 3)
    n, rng = 70, random.Random(15)
    pairs = [*((i, i + 1) for i in range(24)), *clustered(rng, n, 0.04)]
    v, e = frames(spark, n, pairs)
    e = e.where("src <> dst")
    near = {x: set() for x in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    snaps = snapshots.snapshots(v, e).cache()
    rows = snaps.collect()
    held = {r["node"]: {x["node"] for x in rows if x["component"] == r["component"] and r["tin"] <= x["tin"] <= r["tout"]} for r in rows}
    want = {k: hops(near, s, hops(near, s, min(s))[1])[0] for k, s in held.items()}
    assert {r["set_id"]: r["diameter"] for r in paths.snapshot_diameters(e, snaps, snaps).collect()} == want
    assert {(r["component"], r["sid"]): r["least"] for r in snapshots.least_members(snaps).collect()} == {(r["component"], r["sid"]): min(held[r["node"]]) for r in rows}
    some = [k for k in held if len(held[k]) in (1, 2, 5, 9, 25, 40)]
    sets = spark.createDataFrame([(k, x) for k in some for x in held[k]], "set_id bigint, node bigint")
    assert {r["set_id"]: r["diameter"] for r in paths.diameters(e, sets).collect()} == {k: want[k] for k in some}
    assert paths.diameters(e, sets.limit(0)).count() == 0
    dist = {r["node"]: r["dist"] for r in paths.bfs(v, e, v.where("node = 0")).collect()}
    full = {0: 0}
    todo = [0]
    for x in todo:
        for w in sorted(near[x]):
            if w not in full:
                full[w] = full[x] + 1
                todo.append(w)
    assert dist == {x: full.get(x, -1) for x in range(n)}
    snaps.unpersist()


def test_connectivity_of_sets_beyond_a_task(spark):
    """Rounds over spread-out vectors against the one-task iteration: a clique, a path, one vertex, two vertices without an edge."""
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(10, 11), (11, 12), (12, 13)]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    sets = spark.createDataFrame([(1, x) for x in range(5)] + [(2, x) for x in range(10, 14)] + [(3, 20), (4, 30), (4, 31)], "set_id bigint, node bigint")
    one = {r["set_id"]: r["lambda2"] for r in paths.lambda2(e, sets, "shift").collect()}
    many = {r["set_id"]: r["lambda2"] for r in paths.lambda2(e, sets, "shift", one_task=4).collect()}
    assert many == pytest.approx(one) and one[1] == pytest.approx(5, abs=1e-6)


def test_two_sweeps_write_their_edges_once(spark, monkeypatch):
    """Repeated edges and both directions of one change no distance."""
    v = spark.range(8).selectExpr("id AS node")
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (1, 2), (2, 3), (3, 4), (2, 6), (5, 5), (None, 3)], "src bigint, dst bigint")
    written = []
    plain = paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, name="step", **kw: (written.append(name), plain(df, name, **kw))[1])
    assert tuple(paths.two_sweep_diameter(v, e).first()) == (4, 4, 0)
    assert written.count("bfs-edges") == 1
