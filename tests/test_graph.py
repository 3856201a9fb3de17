"""Graph operators against brute force on small random graphs."""

import itertools
import random
import re

import pytest

from graphloom.operators import cores, features, graph, paths, peel, snapshots
from graphloom.operators.components import connected_components


def random_graph(n, p, seed):
    rng = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def frames(spark, n, pairs):
    return spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "src bigint, dst bigint")


def adjacency(n, pairs):
    adj = {v: set() for v in range(n)}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def brute_peel(n, pairs):
    adj, out = adjacency(n, pairs), []
    while adj:
        v = min(adj, key=lambda x: (len(adj[x]), x))
        out.append((v, len(adj[v])))
        for w in adj.pop(v):
            adj[w].discard(v)
    return out


def component(adj, start, allowed):
    seen, todo = {start}, [start]
    while todo:
        for w in adj[todo.pop()]:
            if w in allowed and w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def statistics(members, pairs):
    inner = [(a, b) for a, b in pairs if a in members and b in members]
    deg = {v: 0 for v in members}
    for a, b in inner:
        deg[a] += 1
        deg[b] += 1
    return len(members), sum(deg.values()), sum((deg[a] - deg[b]) ** 2 for a, b in inner)


GRAPHS = [(14, 0.12, 1), (12, 0.4, 2), (20, 0.08, 3)]


@pytest.mark.parametrize("n,p,seed", GRAPHS)
def test_peel_and_snapshots(spark, n, p, seed):
    pairs = random_graph(n, p, seed)
    v, e = frames(spark, n, pairs)
    want = brute_peel(n, pairs)
    got = [(r["node"], r["deg"]) for r in peel.peel_order(v, e).orderBy("pos").collect()]
    assert got == want

    adj, order = adjacency(n, pairs), [v for v, _ in want]
    snaps = snapshots.snapshots(v, e).collect()
    assert sorted(r["node"] for r in snaps) == list(range(n))
    for r in snaps:
        allowed = set(order[order.index(r["node"]) :])
        members = component(adj, r["node"], allowed)
        assert statistics(members, pairs) == (r["nc"], r["sum_deg"], r["q"])
        inside = {x["node"] for x in snaps if x["component"] == r["component"] and r["tin"] <= x["tin"] <= r["tout"]}
        assert inside == members
        deg = {x: len(adj[x]) for x in range(n)}
        own = {x: len(adj[x] & members) for x in members}
        full = sum(own[x] * deg[x] ** 2 for x in members) - 2 * sum(deg[a] * deg[b] for a, b in pairs if a in members and b in members)
        assert full == r["q_full"]

    best = snapshots.best_per_node(snapshots.snapshots(v, e), snapshots.score(2.0)).collect()
    by = {(r["component"], r["sid"]): r for r in snaps}
    for b in best:
        own = next(x for x in snaps if x["node"] == b["node"])
        holders = [x for x in snaps if x["component"] == own["component"] and x["tin"] <= own["tin"] <= x["tout"]]
        top = max(holders, key=lambda x: (x["nc"] / (x["q"] + 2.0), x["nc"], -x["sid"]))
        assert by[b["component"], b["sid"]]["node"] == top["node"]


@pytest.mark.parametrize("n,p,seed", GRAPHS[:2])
def test_edge_steps_see_at_least_the_vertex_steps(spark, n, p, seed):
    pairs = random_graph(n, p, seed)
    v, e = frames(spark, n, pairs)
    by_edge = snapshots.best_by_edge(v, e, 2.0).collect()
    adj = adjacency(n, pairs)
    top = {}
    for r in by_edge:
        top.setdefault(r["component"], [r["score"], r["size"], set()])[2].add(r["node"])
    for score, size, members in top.values():
        assert len(members) == size
        assert component(adj, next(iter(members)), members) == members
    best = snapshots.best(snapshots.snapshots(v, e), snapshots.score(2.0)).first()["score"]
    assert max(t[0] for t in top.values()) >= best - 1e-12


# Vertices, edges and the known RMC of three small graphs.
KNOWN_RMC = [
    (8, "1-2 1-3 1-4 2-3 2-4 3-4 1-5 2-6 3-7 4-8", 12),
    (16, "6-14 4-11 12-8 13-4 15-11 6-9 5-8 15-4 2-8 9-1 7-10 3-8 2-16 13-15 9-3 14-5 10-5 1-5 3-12 14-9 14-1", 16),
    (16, "1-16 14-9 15-6 2-7 11-5 15-2 11-1 1-10 5-1 6-13 5-15 11-8 13-12 4-8 5-6 15-16 12-2 14-3 5-10 15-1 5-12 9-3 13-10 13-7 11-15 4-10 16-4", 26),
]


@pytest.mark.parametrize("n,text,rmc", KNOWN_RMC)
def test_known_rmc(spark, n, text, rmc):
    pairs = [tuple(map(int, x.split("-"))) for x in text.split()]
    v, e = spark.range(1, n + 1).withColumnRenamed("id", "node"), graph.simple(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    assert snapshots.rmc(snapshots.snapshots(v, e)).first()["rmc"] == rmc


def test_small_rmc_cases(spark):
    # two triangles joined by a path, and a complete graph of 4: 4 * 3
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (4, 6), (7, 8), (7, 9), (7, 10), (8, 9), (8, 10), (9, 10)]
    v, e = frames(spark, 12, pairs)
    assert snapshots.rmc(snapshots.snapshots(v, e)).first()["rmc"] == 14  # seven vertices of degree two or more, against the complete's 12
    assert cores.degeneracy(v, e).first()["degeneracy"] == 3


def test_rmc_is_best_core_component(spark):
    for n, p, seed in GRAPHS:
        pairs = random_graph(n, p, seed)
        v, e = frames(spark, n, pairs)
        adj, best = adjacency(n, pairs), 0
        for k in range(1, n):
            live = set(range(n))
            while drop := {x for x in live if len(adj[x] & live) < k}:
                live -= drop
            best = max([best, *(k * len(component(adj, x, live)) for x in live)])
        assert snapshots.rmc(snapshots.snapshots(v, e)).first()["rmc"] == best


def test_complete_graph_has_no_energy(spark):
    v, e = frames(spark, 5, list(itertools.combinations(range(5), 2)))
    top = snapshots.best(snapshots.snapshots(v, e), snapshots.score(1.0)).first()
    assert (top["nc"], top["q"], top["score"]) == (5, 0, 5.0)


def test_components(spark, monkeypatch):
    from graphloom.operators import components as c

    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)]
    v = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 200]], "node bigint")
    e = spark.createDataFrame(path, "src bigint, dst bigint")
    want = {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    for finish in (10_000, 0):  # by the last step alone, and by contraction alone
        monkeypatch.setattr(c, "FINISH_EDGES", finish)
        assert {r["node"]: r["component"] for r in connected_components(v, e).collect()} == want
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    assert {r["component"] for r in connected_components(v, empty).collect()} == set(want)


@pytest.mark.parametrize("n,p,seed", GRAPHS[:2])
def test_cores(spark, n, p, seed):
    pairs = random_graph(n, p, seed)
    v, e = frames(spark, n, pairs)
    adj = adjacency(n, pairs)
    numbers = {r["node"]: r["core"] for r in cores.core_numbers(v, e).collect()}
    for k in (1, 2, 3):
        live = set(range(n))
        while drop := {x for x in live if len(adj[x] & live) < k}:
            live -= drop
        assert {r["node"] for r in cores.kcore(e, k).collect()} == live == {x for x, c in numbers.items() if c >= k}


def test_distances(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (6, 7)]
    v, e = frames(spark, 8, pairs)
    start = spark.createDataFrame([(1,)], "node bigint")
    assert {r["node"]: r["dist"] for r in paths.bfs(v, e, start).collect()} == {0: 1, 1: 0, 2: 1, 3: 2, 4: 3, 5: -1, 6: -1, 7: -1}
    d = paths.two_sweep_diameter(v, e, start).first()
    assert (d["diameter"], d["a"], d["b"]) == (4, 4, 0)
    seeds = spark.createDataFrame([(0, 9), (4, 5)], "node bigint, owner bigint")
    got = {r["node"]: (r["dist"], r["owner"]) for r in paths.owners(e, seeds, 2).collect()}
    assert got == {0: (0, 9), 1: (1, 9), 2: (2, 5), 3: (1, 5), 4: (0, 5)}


def test_lambda2_of_known_graphs(spark):
    complete = list(itertools.combinations(range(6), 2))
    v, e = frames(spark, 6, complete)
    sets = v.selectExpr("7L AS set_id", "node")
    assert paths.lambda2(e, sets, "shift").first()["lambda2"] == pytest.approx(6, abs=1e-6)
    assert paths.lambda2(e, sets, "damped").first()["lambda2"] == pytest.approx(6, abs=1e-6)
    assert paths.diameters(e, sets).first()["diameter"] == 1


def test_set_relations(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3)]
    v, e = frames(spark, 5, pairs)
    e = graph.simple(e)
    m = spark.createDataFrame([(0,), (1,), (2,)], "node bigint")
    s = graph.set_statistics(e, m).first()
    assert (s["size"], s["n_edges"], s["min_deg"], s["max_deg"], s["density"], s["connected"]) == (3, 3, 2, 2, 1.0, True)
    inside, outside = graph.neighbours(e, m)
    assert ({r["node"] for r in inside.collect()}, {r["node"] for r in outside.collect()}) == ({0, 1, 2}, {3})
    assert graph.simple(spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "src bigint, dst bigint")).count() == 1


@pytest.mark.parametrize("n, p, seed", GRAPHS)
def test_cores_by_rounds(spark, monkeypatch, n, p, seed):
    pairs = random_graph(n, p, seed)
    v, e = frames(spark, n, pairs)
    want = {r["node"]: r["core"] for r in cores.core_numbers(v, e).collect()}
    assert {r["node"]: r["core"] for r in cores.core_rounds(v, e).collect()} == want
    monkeypatch.setattr(cores, "ONE_TASK_EDGES", 0)
    assert cores.degeneracy(v, e).first()["degeneracy"] == max(want.values())
    for k in (1, 2, 3):
        assert {r["node"] for r in cores.kcore(e, k).collect()} == {x for x, c in want.items() if c >= k}


def test_kcore_of_a_long_path_is_empty(spark):
    _, e = frames(spark, 3_000, [(i, i + 1) for i in range(2_999)])
    assert cores.kcore(e, 2).count() == 0 and cores.kcore(e, 1).count() == 3_000
    assert cores.kcore(e.limit(0), 1).count() == 0


def _exchanges(df):
    """What the rows of a plan are shuffled by."""
    return re.findall(r"Exchange (\w+\([a-z_]+)#", df._jdf.queryExecution().executedPlan().toString())


def test_edges_stay_where_they_are_beside_few_vertices(spark, monkeypatch):
    pairs = random_graph(30, 0.3, 5)
    v, e = frames(spark, 30, pairs)
    adj = adjacency(30, pairs)
    near = graph.neighbour_degree_sum(v, e)
    assert "hashpartitioning(d" not in _exchanges(near)
    assert {r["node"]: r["nbr_deg"] for r in near.collect()} == {a: sum(len(adj[b]) for b in adj[a]) for a in adj}
    x = spark.createDataFrame([(i, 0, float(i)) for i in range(30)], "node bigint, j int, x double")
    sent = features.propagate(v, e, x)
    assert "hashpartitioning(s" not in _exchanges(sent)
    root = {a: (len(adj[a]) + 1) ** -0.5 for a in adj}
    want = {a: root[a] * sum(b * root[b] for b in [a, *adj[a]]) for a in adj}
    assert {r["node"]: r["x"] for r in sent.collect()} == pytest.approx(want)
    read = []
    monkeypatch.setattr(cores, "materialise", lambda df, name="step", keep=cores.materialise: read.append(_exchanges(df) if name == "kcore" else []) or keep(df, name))
    monkeypatch.setattr(cores, "ONE_TASK_EDGES", 10)
    want = {r["node"] for r in peel.peel_by_component(v, e).where("core >= 5").select("node").collect()}
    assert {r["node"] for r in cores.kcore(e, 5).collect()} == want
    assert not any("src" in x or "dst" in x for step in read for x in step)


def test_merged_edges_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 20)
    e = spark.createDataFrame([(a, b) for a, b in random_graph(20, 0.5, 6) for a, b in ((a, b), (b, a), (a, a))], "src bigint, dst bigint")
    got = graph.simple(e, rows=e.count())
    assert got.rdd.getNumPartitions() == -(-e.count() // 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.simple(e).collect())) == sorted(random_graph(20, 0.5, 6))
