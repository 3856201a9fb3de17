"""Pooling networks: losses of five steps against NumPy with numeric gradients, and learning."""

import random

import numpy as np
import pytest

from graphloom.operators import networks, packed


def ahat(n, pairs):
    a = np.eye(n)
    for i, j, w in pairs:
        a[i, j] += w
        a[j, i] += w
    d = a.sum(1)
    return a / np.sqrt(np.outer(d, d))


def clusters_of_top(raw, near, out_degree, k):
    kept = sorted(range(len(raw)), key=lambda v: (-raw[v], v))[:k]
    pick = lambda vs: max(vs, key=lambda v: (out_degree[v], -v))
    return np.array([kept.index(v if v in kept else pick([u for u in near[v] if u in kept] or kept)) for v in range(len(raw))])


def losses_by_numpy(n, pairs, x, y, train, clusters, hidden, classes, steps, rate=0.01, decay=5e-4):
    a = ahat(n, [(i, j, 1) for i, j in pairs])
    near, deg = [[] for _ in range(n)], [0] * n
    for i, j in pairs:
        near[i].append(j)
        near[j].append(i)
        deg[i] += 1

    def loss(flat, w0):
        w = w0.like(flat)
        x1 = np.maximum(a @ (x @ w.first) + w.first_bias, 0)
        raw = x1 @ w.score
        c = clusters_of_top(raw, near, deg, clusters) if isinstance(clusters, int) else clusters
        k = c.max() + 1
        member = np.eye(k)[c]
        mean = member.T @ (x1 * np.tanh(raw)[:, None]) / member.sum(0)[:, None]
        between = {}
        for i, j in pairs:
            if c[i] != c[j]:
                key = tuple(sorted((c[i], c[j])))
                between[key] = between.get(key, 0) + 1
        up = ahat(k, [(i, j, w) for (i, j), w in between.items()]) @ (mean @ w.pooled) + w.pooled_bias
        z = up[c] + x1 @ w.skip + w.skip_bias
        z = z - z.max(1, keepdims=True)
        return -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(n), y][train])

    w0 = networks.Weights.drawn(x.shape[1], hidden, classes, 42)
    flat, m, s, out = w0.flat(), 0, 0, []
    for t in range(1, steps + 1):
        out.append(loss(flat, w0))
        g = np.array([(loss(flat + e, w0) - loss(flat - e, w0)) / 2e-6 for e in np.eye(len(flat)) * 1e-6]) + decay * flat
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return [*out, loss(flat, w0)]


def two_groups(spark, n=24):
    rng = random.Random(31)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.4 if i % 2 == j % 2 else 0.04)]
    x = np.array([[1.0, rng.gauss(i % 2, 0.8), rng.gauss(0, 1)] for i in range(n)])
    y = np.array([i % 2 for i in range(n)])
    role = ["train" if i < 10 else "val" if i < 14 else "test" for i in range(n)]
    v = spark.range(n).withColumnRenamed("id", "node")
    e = spark.createDataFrame([*pairs, pairs[0][::-1], (2, 2), (None, 1)], "src bigint, dst bigint")
    f = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node bigint, vector array<double>")
    lab = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "node bigint, label bigint")
    split = spark.createDataFrame(list(enumerate(role)), "node bigint, role string")
    return n, pairs, x, y, role, (v, e, f, lab, split)


@pytest.mark.parametrize("kind", ["seeded", "top"])
def test_five_steps_against_numpy(spark, kind):
    n, pairs, x, y, role, frames = two_groups(spark)
    given = np.array([i % 5 for i in range(n)])
    clusters = spark.createDataFrame([(i, int(c)) for i, c in enumerate(given)], "node bigint, cluster_id bigint") if kind == "seeded" else 6
    steps = 5 if kind == "seeded" else 2
    pred, losses = networks.train(*frames, clusters, hidden=4, rounds=steps)
    want = losses_by_numpy(n, pairs, x, y, np.array(role) == "train", given if kind == "seeded" else 6, 4, 2, steps)
    assert losses == pytest.approx(want, abs=1e-6)
    assert pred.count() == n and set(pred.columns) == {"node", "label", "pred", "role"}


@pytest.mark.parametrize("kind", ["seeded", "top"])
def test_packed_steps_against_numpy(spark, kind, monkeypatch):
    monkeypatch.setattr(networks, "PACK_EDGES", 1)
    monkeypatch.setattr(packed, "DENSITY", 1)
    monkeypatch.setattr(packed, "PIECE", 40)
    monkeypatch.setattr(networks.Rows, "of", None)  # the plain way is not taken
    n, pairs, x, y, role, frames = two_groups(spark)
    given = np.array([i % 5 - 2 for i in range(n)])
    clusters = spark.createDataFrame([(i, int(c)) for i, c in enumerate(given)], "node bigint, cluster_id bigint") if kind == "seeded" else 6
    steps = 3 if kind == "seeded" else 2
    pred, losses = networks.train(*frames, clusters, hidden=4, rounds=steps)
    want = losses_by_numpy(n, pairs, x, y, np.array(role) == "train", given + 2 if kind == "seeded" else 6, 4, 2, steps)
    assert losses == pytest.approx(want, abs=1e-6) and pred.count() == n


def test_packed_graph_as_rows(spark, monkeypatch):
    """Repeated edges, loops, nulls, foreign ends, vertices without edges, vertices in no cluster."""
    monkeypatch.setattr(packed, "PIECE", 30)
    rng = random.Random(7)
    e = spark.createDataFrame([(rng.randrange(20) * 3, rng.randrange(20) * 3) for _ in range(150)] + [(None, 3), (3, 3), (3, 9999)], "src bigint, dst bigint")
    own = spark.createDataFrame([(3 * i,) for i in range(25)], "node bigint")
    plain, deg = networks.Rows.of(own, e)
    held, packed_deg = networks.Packed.of(own, e, 25, e.count())
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(deg) == rows(packed_deg)
    vectors = spark.createDataFrame([(3 * i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(25)], "node bigint, v array<double>")
    for (a, v), (b, w) in zip(rows(plain.convolved(vectors, 2)), rows(held.convolved(vectors, 2)), strict=True):
        assert a == b and v == pytest.approx(w, abs=1e-12)
    kept = spark.createDataFrame([(9, (5, -9, 0)), (0, (5, 0, 1)), (30, (7, -30, 2))], "node bigint, pick struct<deg: bigint, low: bigint, cluster_id: bigint>")
    assert rows(plain.nearest(kept)) == rows(held.nearest(kept)) != []
    of = spark.createDataFrame([(3 * i, 10 * (i % 4) - 10) for i in range(18)], "node bigint, cluster_id bigint")
    assert rows(plain.between(of)) == rows(held.between(of)) != []


def test_nothing_to_learn_from(spark):
    *_, (v, e, f, lab, split) = two_groups(spark)
    pred, losses = networks.train(v, e, f, lab, split.replace("train", "test", "role"), 3, hidden=2, rounds=2)
    assert losses == [0.0] and pred.count() == 24
    assert networks.train(v, e, f.where("false"), lab, split, 3, hidden=2, rounds=2)[0].count() == 0
