"""Null, repeated and foreign rows, and empty tables, through the graph operators."""

import os

import pytest

from graphloom.functions import metrics, storage
from graphloom.operators import components, cores, features, graph, partitions, paths, peel, snapshots


@pytest.fixture(scope="module")
def odd(spark):
    v = spark.createDataFrame([(0,), (1,), (1,), (2,), (5,), (None,)], "node bigint")
    e = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 2), (None, 1), (1, None), (None, None), (7, 8), (2, 9)], "src bigint, dst bigint")
    return v, e


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_peel_snapshots_and_cores(odd):
    v, e = odd
    assert pairs(peel.peel_order(v, e)) == [(1, 5, 0), (2, 2, 1), (3, 0, 2), (4, 1, 0)]
    assert pairs(snapshots.snapshots(v, e).select("node", "nc")) == [(0, 2), (1, 1), (2, 3), (5, 1)]
    want = [(0, 2), (1, 2), (2, 1), (5, 0)]
    assert pairs(cores.core_numbers(v, e)) == pairs(cores.core_rounds(v, e)) == pairs(cores.core_rounds(v, e, region_edges=1)) == want
    assert cores.rmc(cores.core_numbers(v, e), e).first()["rmc"] == 4


def test_components_and_searches(odd):
    v, e = odd
    assert pairs(components.connected_components(v, e)) == [(0, 0), (1, 0), (2, 0), (5, 5), (None, None)]
    assert pairs(paths.bfs(v, e, v.where("node = 0"))) == [(0, 0), (1, 1), (1, 1), (2, 2), (5, -1), (None, -1)]
    assert pairs(graph.simple(e)) == [(0, 1), (1, 2), (2, 9), (7, 8)]
    own, inner = graph.proper(v, e)
    assert pairs(own) == [(0,), (1,), (2,), (5,)] and pairs(inner) == [(0, 1), (0, 1), (1, 2)]


def test_partitions_features_and_metrics(spark, odd):
    v, e = odd
    p = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (None, 1), (5, None)], "node bigint, cluster_id bigint")
    assert pairs(partitions.cluster_edges(e, p)) == [(0, 1, 1)]
    assert pairs(partitions.compress(e, p, 1)) == [(0, 0), (1, 0), (2, 0), (None, 0)]
    f = spark.createDataFrame([(0, [1.0, 3.0]), (1, None), (2, []), (5, [None, 2.0])], "node bigint, vector array<double>")
    assert {r["node"]: r["vector"] for r in features.row_normalise(f).collect()} == {0: [0.25, 0.75], 1: None, 2: [], 5: [None, 1.0]}
    m = spark.createDataFrame([(0, 0, 0), (1, None, 1), (2, 1, None)], "node bigint, label bigint, pred bigint")
    assert metrics.accuracy(m).first()["coverage"] == pytest.approx(2 / 3)


def test_empty_tables(odd):
    v, e = (x.limit(0) for x in odd)
    for made in (peel.peel_order(v, e), snapshots.snapshots(v, e), cores.core_numbers(v, e), cores.core_rounds(v, e), cores.kcore(e, 1), components.connected_components(v, e),
                 peel.suffixes(v, e), graph.degree(v, e), paths.owners(e, v.selectExpr("node", "node AS owner")), cores.core_forest(cores.core_rounds(v, e), e)):
        assert made.count() == 0
    assert pairs(odd[0].transform(lambda x: graph.degree(x, e))) == [(0, 0), (1, 0), (1, 0), (2, 0), (5, 0), (None, 0)]


def test_scratch_deletes_its_steps(spark, odd):
    def files(df):
        return [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://").removeprefix("file:"))]

    kept = storage.materialise(odd[0], "kept")
    with storage.scratch(spark):
        inner = storage.materialise(odd[0], "inner")
        n = components.connected_components(*odd).count()
        assert files(inner)
    assert n == 5 and files(kept) and not files(inner)
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        lost = storage.materialise(odd[0], "lost")
        1 / 0
    assert not files(lost)
