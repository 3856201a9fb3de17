"""Packed adjacency: the same numbers as the plain ways, on odd rows too."""

import numpy as np
import pandas as pd
import pytest

from graphloom.operators import components, cores, graph, packed, paths, peel, snapshots


@pytest.fixture
def odd(spark):
    """A dense part, a chain that hangs on it, a part of its own, an isolated vertex; repeated edges, loops, nulls, foreign ends."""
    rng = np.random.default_rng(5)
    e = [(int(a) * 7, int(b) * 7) for a, b in rng.integers(0, 60, (900, 2))]
    e += [(7 * i, 7 * (i + 1)) for i in range(59, 90)] + [(1000 + i, 1000 + j) for i in range(5) for j in range(i)] + [(None, 7), (7, 99999), (3, 3)]
    nodes = [7 * i for i in range(91)] + [1000 + i for i in range(5)] + [3, 3, None]
    return spark.createDataFrame([(x,) for x in nodes], "node bigint"), spark.createDataFrame(e, "src bigint, dst bigint")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_packed_cores(odd, monkeypatch):
    v, e = odd
    want = _rows(peel.peel_by_component(v, e).select("node", "core"))
    monkeypatch.setattr(packed, "PIECE", 200)
    got, final = packed.core_numbers(v, e, e.count())
    assert final and _rows(got) == want
    # held up by the chain, regions go on from numbers that are still too large
    early, final = packed.core_numbers(v, e, e.count(), 2)
    assert not final and _rows(early) != want
    monkeypatch.setattr(cores, "ONE_TASK_EDGES", 10)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(cores, "PACKED_ROUNDS", 2)
    assert _rows(cores.core_rounds(v, e)) == want


def test_packed_peel(odd, monkeypatch):
    v, e = odd
    want = _rows(peel.peel_by_component(v, e))
    order = _rows(peel.peel_order(v, e))
    monkeypatch.setattr(peel, "ONE_BATCH", 10)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(packed, "PIECE", 200)
    assert _rows(peel.peel_by_component(v, e)) == want
    assert _rows(peel.peel_order(v, e)) == order
    assert _rows(peel.peel_by_component(v, e.distinct())) != want  # repeated edges count


def test_thinned_edges(odd, monkeypatch):
    v, e = odd
    core = cores.core_numbers(v, e)
    monkeypatch.setattr(components, "THIN", 50)
    want = _rows(cores.largest_components(core, e)), _rows(cores.rmc(core, e)), _rows(components.connected_components(v, e))
    monkeypatch.setattr(cores, "FINISH_EDGES", 500)
    monkeypatch.setattr(components, "FINISH_EDGES", 500)
    assert (_rows(cores.largest_components(core, e)), _rows(cores.rmc(core, e)), _rows(components.connected_components(v, e))) == want


def test_spanning_forest_keeps_every_level():
    rng = np.random.default_rng(3)
    e = pd.DataFrame({"u": rng.integers(0, 80, 2000), "v": rng.integers(0, 80, 2000), "level": rng.integers(1, 6, 2000)})
    e = e[e["u"] != e["v"]]
    kept = components.spanning(e)
    assert len(kept) < 80
    for k in range(1, 6):
        label = lambda x: components.least_labels(80, x["u"].to_numpy(), x["v"].to_numpy()).tolist()
        assert label(e[e["level"] >= k]) == label(kept[kept["level"] >= k])


def test_pairs_are_dealt_out_as_facts_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_FACTS", 50)
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"g": rng.integers(0, 150, 1000), "i": rng.integers(0, 40, 1000)})
    pairs = graph.project_pairs(spark.createDataFrame(f), "i", "g")
    assert pairs.rdd.getNumPartitions() == 2 * 1000 // 50
    f = f.drop_duplicates()
    m = f.merge(f, on="g").query("i_x < i_y")
    assert _rows(pairs) == sorted(((int(a), int(b), int(n)) for (a, b), n in m.groupby(["i_x", "i_y"]).size().items()), key=repr)


@pytest.fixture
def parts(spark):
    """Two dense parts that a late vertex joins, one of their own, isolated vertices; every edge once, some ends foreign."""
    rng = np.random.default_rng(8)
    e = {(min(a, b), max(a, b)) for n, m, o in ((40, 500, 0), (30, 200, 50), (12, 60, 100)) for a, b in (rng.integers(0, n, (m, 2)) * 7 + o * 7).tolist()}
    e |= {(7 * 3, 7 * 45), (7 * 45, 7 * 60), (7 * 45, 7 * 61), (7, 99_999)}
    nodes = [7 * i for i in range(120)] + [None, 7]
    return spark.createDataFrame([(x,) for x in nodes], "node bigint"), spark.createDataFrame(sorted(e), "src bigint, dst bigint")


def _packed_graphs(monkeypatch):
    monkeypatch.setattr(peel, "ONE_BATCH", 10)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(packed, "PIECE", 200)


def test_packed_snapshots(parts, odd, monkeypatch):
    columns = ["component", "sid", "node", "deg", "nc", "sum_deg", "q", "q_full", "parent"]
    plain = snapshots.snapshots(*parts).select(columns), snapshots.snapshots(*odd).select(columns)
    want = [_rows(x) for x in plain]
    held = lambda s: _rows(snapshots.members(s, s))
    sets = held(snapshots.snapshots(*parts))
    _packed_graphs(monkeypatch)
    monkeypatch.setattr(snapshots, "_replay", None)  # the plain way is not taken
    got = snapshots.snapshots(*parts)
    assert _rows(got.select(columns)) == want[0] and held(got) == sets
    monkeypatch.undo()
    _packed_graphs(monkeypatch)
    assert _rows(snapshots.snapshots(*odd).select(columns)) == want[1]  # repeated edges: the plain way


@pytest.mark.parametrize("eps", [1.0, 100.0, 1e4])
def test_packed_best_by_edge(parts, monkeypatch, eps):
    want = _rows(snapshots.best_by_edge(*parts, eps))
    _packed_graphs(monkeypatch)
    monkeypatch.setattr(snapshots, "_edge_replay", None)
    assert _rows(snapshots.best_by_edge(*parts, eps)) == want


def test_packed_connectivity(odd, spark, monkeypatch):
    """Sets that overlap, with loops, repeated edges, isolated vertices and nulls: as in one task, none of them as rows."""
    v, e = odd
    sets = [(1, 7 * i) for i in range(10)] + [(2, 7 * i) for i in range(5, 12)] + [(2, 8)] + [(3, 1000 + i) for i in range(5)] + [(4, 7), (5, 3)]
    sets = spark.createDataFrame(sets, "set_id bigint, node bigint")
    monkeypatch.setattr(packed, "PIECE", 20)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(paths, "power_rounds", None)
    for variant in ("shift", "damped"):
        one = {r["set_id"]: r["lambda2"] for r in paths.lambda2(e, sets, variant).collect()}
        many = {r["set_id"]: r["lambda2"] for r in paths.lambda2(e, sets, variant, one_task=8).collect()}
        assert len(many) == 5 and many == pytest.approx(one, rel=1e-9)
