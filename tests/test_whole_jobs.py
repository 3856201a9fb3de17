"""Queries that do their whole job, on small made tables against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from graphloom.operators import features, packed, paths, peel, replay, seeds, snapshots
from graphloom.plans import generate
from graphloom.plans.queries import QUERIES, SQL


@pytest.fixture
def path(tmp_path):
    """A path of 14 suppliers (neighbours share an order) and one that shares none."""
    orders = [(i, s) for i in range(13) for s in (i, i + 1)] + [(99, 14)]
    pd.DataFrame(orders, columns=["l_orderkey", "l_suppkey"]).to_parquet(tmp_path / "lineitem.parquet")
    suppliers = pd.DataFrame({"s_suppkey": range(15), "s_acctbal": [100.0 * (i % 4) - 100 for i in range(15)], "s_nationkey": [i % 3 for i in range(15)]})
    suppliers.to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"n_nationkey": range(3), "n_regionkey": [0, 1, 1]}).to_parquet(tmp_path / "nation.parquet")
    pd.DataFrame({"r_regionkey": range(2)}).to_parquet(tmp_path / "region.parquet")
    return str(tmp_path)


def _both(spark, name, d):
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), c.execute(SQL[name]).df()
    return [sorted(map(tuple, x[sorted(x.columns)].itertuples(index=False))) for x in (got, want)]


def test_owners_reach_far_vertices(spark, path):
    got, want = _both(spark, "nearest_seed_owner", path)
    assert got == want and len(got) == 14
    assert max(dist for dist, _, _ in got) == 8  # the seeds are 1 to 5, the last vertex is 13


def test_nearest_seed_eval_stays_within_two_hops(spark, path):
    got, want = _both(spark, "nearest_seed_eval", path)
    assert got == want and got[0][1] == pytest.approx(8 / 15)  # coverage: 0 to 7


def test_virtual_edges_of_a_large_set(spark):
    """More than 20,000 chosen vertices, in three blocks; no pair is counted twice or left out."""
    n = 20_500
    chosen = spark.range(n).selectExpr("CASE WHEN id < 5 THEN id ELSE id + 7 END AS node").unionByName(spark.createDataFrame([(3,), (None,)], "node bigint"))
    e = spark.createDataFrame([(1, 2), (1, 2), (0, 20_000), (5, 6), (9, 30_000), (12, 3)], "src bigint, dst bigint")
    out = features.virtual_weights(e, chosen)
    assert out.groupBy("n").count().orderBy("n").collect() == [(1, 3), (3, n * (n - 1) // 2 - 2), (4, 1), (5, 1)]
    sums = out.where("n >= 3").selectExpr("sum(src) AS a", "sum(dst) AS b", "count_if(src >= dst) AS wrong").first()
    ids = [x if x < 5 else x + 7 for x in range(n)]
    assert tuple(sums) == (sum(x * (n - 1 - i) for i, x in enumerate(ids)), sum(x * i for i, x in enumerate(ids)), 0)


def test_virtual_edges_by_block(spark, path, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 2)
    got, want = _both(spark, "virtual_edges", path)
    assert got == want
    c = spark.createDataFrame([(i,) for i in (4, 1, 9, 4, 7, None)], "node bigint")
    rows = features.virtual_edges(spark.createDataFrame([(1, 4)], "src bigint, dst bigint"), c, 2).groupBy("src", "dst").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 4, 3), (1, 7, 2), (1, 9, 2), (4, 7, 2), (4, 9, 2), (7, 9, 2)]


def test_replay_sends_coded_lists():
    """Lists of neighbours come back as they were, and what every group is sent is far below 4 bytes an edge."""
    rng = np.random.default_rng(4)
    lists = [np.sort(rng.choice(60_000, k, replace=False)).astype(np.int32) for k in (0, 2_000, 1, 0, 900, 1_500)] + [np.array([0, 3_999_999], np.int32)]
    counts, flat = np.array([len(x) for x in lists]), np.concatenate(lists)
    cell = replay._coded(flat, counts)[0]
    assert (replay._decoded(cell, counts) == flat).all() and len(cell.as_py()) < 1.5 * len(flat)
    none = np.zeros(3, np.int64)
    assert len(replay._decoded(replay._coded(np.empty(0, np.int32), none)[0], none)) == 0
    parts = pa.RecordBatch.from_pydict({"block": [0], "own": [np.arange(len(lists), dtype=np.int32).tobytes()], "counts": [counts.astype(np.int32).tobytes()], "near": [cell.as_py()]})
    rows = list(replay._dealt(2, False)(iter([parts])))
    own = np.arange(len(lists))
    for g, r in enumerate(rows):
        mine = [x for t, x in enumerate(lists) if t % 2 == g]
        assert (replay._decoded(r["near"][0], counts[own % 2 == g]) == np.concatenate(mine)).all()
        before = np.frombuffer(r["before"][0].as_py(), np.int32)
        assert (replay._decoded(r["early"][0], before) == np.concatenate([x[x < t] for t, x in enumerate(lists)])).all()


def _dense_gcn(n, pairs, x, y, role, hidden, rounds, rate=0.01, decay=5e-4, patience=50):
    """The network on a full matrix, whose neighbours count once."""
    a = np.eye(n)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    f = 1 / np.sqrt(a.sum(1))
    a = a * f[:, None] * f
    rng, k = np.random.default_rng(42), y.max() + 1
    w = [rng.normal(0, np.sqrt(2 / (p + q)), (p, q)) for p, q in ((x.shape[1], hidden), (hidden, k))]
    m, s, best, kept, since = [0, 0], [0, 0], -1.0, w, 0
    train, val = role == "train", role == "val"
    hidden_of = lambda: np.maximum(a @ x @ w[0], 0)
    for t in range(1, rounds + 1):
        h = hidden_of()
        e = np.exp(a @ h @ w[1])
        g = a.T @ (np.where(train[:, None], e / e.sum(1, keepdims=True) - np.eye(k)[y], 0) / train.sum())
        grads = [(a @ x).T @ ((g @ w[1].T) * (h > 0)) + decay * w[0], h.T @ g]
        m, s = [0.9 * p + 0.1 * q for p, q in zip(m, grads)], [0.999 * p + 0.001 * q * q for p, q in zip(s, grads)]
        w = [p - rate * (q / (1 - 0.9**t)) / (np.sqrt(r / (1 - 0.999**t)) + 1e-8) for p, q, r in zip(w, m, s)]
        score = ((a @ hidden_of() @ w[1]).argmax(1) == y)[val].mean() if val.any() else t
        if score > best:
            best, kept, since = score, w, 0
        elif (since := since + 1) >= patience:
            break
    w = kept
    return (a @ hidden_of() @ w[1]).argmax(1)


@pytest.mark.parametrize("held,near", [(True, 1_000_000), (True, 150), (False, 150)])
def test_gcn_without_a_full_matrix(spark, monkeypatch, held, near):
    """The same answers as with a full matrix, in one task and in rounds of jobs; no task is given all edges."""
    rng, n = np.random.default_rng(9), 60
    pairs = [(i, j) for i, j in rng.integers(0, n, (240, 2)).tolist() if i != j]
    x, y = rng.normal(size=(n, 3)), rng.integers(0, 3, n)
    x[:, 0] += y
    role = np.array(["train"] * 15 + (["val"] * 10 if held else []) + ["none"] * (35 if held else 45))
    v = spark.createDataFrame([(3 * i,) for i in range(n)], "node bigint")
    e = spark.createDataFrame([(3 * i, 3 * j) for i, j in pairs] + [(None, 3), (3, 3), (3, 7)], "src bigint, dst bigint")
    f = spark.createDataFrame([(3 * i, x[i].tolist()) for i in range(n)], "node bigint, vector array<double>")
    lab = spark.createDataFrame([(3 * i, int(c)) for i, c in enumerate(y)], "node bigint, label bigint")
    split = spark.createDataFrame([(3 * i, str(r)) for i, r in enumerate(role)], "node bigint, role string")
    monkeypatch.setattr(features, "TASK_NEAR", near)
    got = features.gcn(v, e, f, lab, split, hidden=4, rounds=12, patience=5).orderBy("node").collect()
    assert [r["node"] for r in got] == [3 * i for i in range(n)] and [r["label"] for r in got] == y.tolist()
    assert [r["pred"] for r in got] == _dense_gcn(n, pairs, x, y, role, 4, 12, patience=5).tolist()
    assert features.gcn(v.limit(0), e, f, lab, split).count() == 0


def test_planted_sweep_spread_out(spark, monkeypatch):
    """Graphs beyond a task give the rows of those within, by packed snapshots as well, and leave nothing behind."""
    args = (spark, 150, [12, 40], [0.8], [0.02, 0.1], [1], 1e3)
    rows = lambda: sorted(map(tuple, generate.sweep(*args).drop("ms").collect()))
    want = rows()
    monkeypatch.setattr(generate, "ONE_TASK_EDGES", 1_000)  # some within, some beyond
    made = []
    keep = generate._methods
    monkeypatch.setattr(generate, "_methods", lambda *a: made.append(a[1:]) or keep(*a))
    assert rows() == want and len(made) == 2
    monkeypatch.setattr(generate, "ONE_TASK_EDGES", 0)
    monkeypatch.setattr(peel, "ONE_BATCH", 10)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(packed, "PIECE", 200)
    args = (spark, 150, [12], [0.8], [0.1], [1], 1e3)
    got = rows()
    monkeypatch.undo()
    assert got == rows()


def test_alphas_of_nested_sets(spark, monkeypatch):
    """The same as with members and inner edges of each set as rows, which are no longer made; several components, a repeated edge, a loop."""
    rng = np.random.default_rng(6)
    e = [(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 60, (220, 2))] + [(200 + i, 201 + i) for i in range(9)] + [(300, 301), (300, 301), (0, 0), (None, 3)]
    v = spark.createDataFrame([(3 * i,) for i in range(60)] + [(200 + i,) for i in range(10)] + [(300,), (301,), (302,)], "node bigint")
    e = spark.createDataFrame(e, "src bigint, dst bigint")
    snaps = snapshots.snapshots(v, e)
    for kind in seeds.KINDS:
        monkeypatch.setattr(paths, "NESTED", 0)
        want = {r["node"]: r["alpha"] for r in seeds.candidates(snaps, e, kind).collect()}
        monkeypatch.setattr(paths, "NESTED", 8_000_000)
        monkeypatch.setattr(paths, "snapshot_diameters", None)
        monkeypatch.setattr(seeds, "members_by_maker", None)
        got = {r["node"]: r["alpha"] for r in seeds.candidates(snaps, e, kind).collect()}
        assert len(want) > 40 and got == want
        monkeypatch.undo()
