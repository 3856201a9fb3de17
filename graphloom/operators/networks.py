"""Graph networks that pool by clusters, trained by joins (survey P18).

A network convolves the features over the graph, gates each vertex, pools the gated vectors by cluster, convolves the cluster
graph, hands its rows back to the vertices and adds a skip connection. Clusters are given (seeded pooling) or are
those of the k vertices of greatest score (top-k pooling; the score is learned through the gate, the choice has no gradient).

Vertex rows stay spread out. A convolution is a join of the normalised edges with the rows and a sum by target; the reverse
pass sends gradients along the same edges, which are symmetric. Gradients of the weights are sums over the rows, formed
in each task and added up by Spark; only they (as many numbers as the model has weights) come to the driver, which keeps the
weights and Adam's moments. No task holds the graph, and no matrix has a row and a column for each vertex. A large dense graph is packed
(``packed``): a pass over its edges reads 4 bytes an edge end, and the vectors are broadcast to the pieces as one packed state.

Defined results: edges count once and both ways; loops and null ends count for nothing; each convolution adds a loop of weight 1.
Vertices without features or label are left out; without a training row the loss is 0 and nothing is learned. An empty
graph gives an empty result. A soft-assignment model is not built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ranks import placed
from graphloom.functions.storage import materialise
from graphloom.operators import packed
from graphloom.operators.graph import out_degree, simple, symmetrise

#: Edges from which a dense graph is packed.
PACK_EDGES = 1_000_000


def links(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(s, d, c)``: symmetric weighted ``pairs(s, d, w)`` and a loop of weight 1 for each vertex, over the roots of both degrees."""
    w = pairs.select("s", "d", F.col("w").cast("double").alias("w")).unionByName(vertices.select(F.col("node").alias("s"), F.col("node").alias("d"), F.lit(1.0).alias("w")))
    deg = materialise(w.groupBy("s").agg(F.sum("w").alias("deg")), "link-degrees")
    out = w.join(deg, "s").join(deg.select(F.col("s").alias("d"), F.col("deg").alias("other")), "d")
    return out.select("s", "d", (F.col("w") / F.sqrt(F.col("deg") * F.col("other"))).alias("c"))


def summed(rows: DataFrame, key: str, width: int, scale=None) -> DataFrame:
    """``(key, v)``: vectors added up by key."""
    part = lambda j: F.col("v")[j] if scale is None else scale * F.col("v")[j]
    return rows.groupBy(key).agg(*(F.sum(part(j)).alias(f"v{j}") for j in range(width))).select(key, F.array(*(f"v{j}" for j in range(width))).alias("v"))


def convolved(edges: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``(node, v)``: the rows ``(node, v)`` sent along the links and added up."""
    sent = edges.join(rows.select(F.col("node").alias("s"), "v"), "s")
    return summed(sent, "d", width, F.col("c")).withColumnRenamed("d", "node")


def _array(column: pd.Series, n: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, n))


def _each(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield run(b)

    return rows.mapInPandas(go, schema)


def _total(rows: DataFrame, run: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of vectors that ``run`` gives for a batch, formed in the tasks first."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size)
        for b in batches:
            if len(b):
                out += run(b)
        yield pd.DataFrame({"k": np.arange(size), "v": out})

    got = rows.mapInPandas(go, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


@dataclass
class Weights:
    first: np.ndarray  # features x hidden
    first_bias: np.ndarray
    score: np.ndarray  # hidden
    pooled: np.ndarray  # hidden x classes
    pooled_bias: np.ndarray
    skip: np.ndarray  # hidden x classes
    skip_bias: np.ndarray

    @staticmethod
    def drawn(inputs: int, hidden: int, classes: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        return Weights(draw(inputs, hidden), np.zeros(hidden), draw(hidden, 1)[:, 0], draw(hidden, classes), np.zeros(classes), draw(hidden, classes), np.zeros(classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    def like(self, flat: np.ndarray) -> Weights:
        cut = np.split(flat, np.cumsum([x.size for x in vars(self).values()])[:-1])
        return Weights(*(c.reshape(x.shape) for c, x in zip(cut, vars(self).values())))


@dataclass
class Rows:
    """A graph as rows: the undirected edges and their normalised links."""

    edges: DataFrame
    links: DataFrame

    @staticmethod
    def of(own: DataFrame, edges: DataFrame) -> tuple[Rows, DataFrame]:
        """The graph of the vertices ``own``, and their out-degrees."""
        e = simple(edges).join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi")
        e = materialise(e.select("src", "dst"), "network-edges")
        joined = materialise(links(own, symmetrise(e).withColumn("w", F.lit(1))), "network-links")
        return Rows(e, joined), materialise(out_degree(own, e), "network-degrees")

    def convolved(self, rows: DataFrame, width: int) -> DataFrame:
        return convolved(self.links, rows, width)

    def nearest(self, kept: DataFrame) -> DataFrame:
        """``(node, near)``: the greatest ``pick`` of the neighbours in ``kept(node, pick)``."""
        return symmetrise(self.edges).join(kept.select(F.col("node").alias("d"), "pick"), "d").groupBy(F.col("s").alias("node")).agg(F.max("pick").alias("near"))

    def between(self, of: DataFrame) -> DataFrame:
        """``(s, d, w)``: how many edges join two different clusters of ``of(node, cluster_id)``, both ways."""
        a = of.select(F.col("node").alias("src"), F.col("cluster_id").alias("s"))
        b = of.select(F.col("node").alias("dst"), F.col("cluster_id").alias("d"))
        pairs = self.edges.join(a, "src").join(b, "dst").where("s <> d").select(F.inline(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))))
        return pairs.groupBy("s", "d").agg(F.count(F.lit(1)).alias("w"))


def _by_number(column: pa.Array, width: int) -> np.ndarray:
    """A column of numbers, or of lists of ``width`` of them, as ``width`` rows."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width).T


@dataclass
class Packed:
    """A dense graph as packed pieces: the vertices' numbers, ``ids(node, i, root)`` with one over the root of the degree (loop counted)."""

    ids: DataFrame
    parts: DataFrame
    n: int

    @staticmethod
    def of(own: DataFrame, edges: DataFrame, n: int, n_edges: int) -> tuple[Packed, DataFrame]:
        ids = packed.numbered(own)
        g = Packed(ids, packed.pieces(ids, edges, n_edges, merge=True).select("own", "counts", "near"), n)

        def degrees(own: np.ndarray, counts: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
            return {"i": own, "all": counts, "later": np.add.reduceat((near > np.repeat(own, counts)).astype(np.int64), np.cumsum(counts) - counts)}

        # numbers follow the ids, so an edge leaves its lesser number
        deg = ids.join(g._each(None, degrees, "i int, all int, later bigint"), "i", "left").na.fill(0, ["all", "later"])
        deg = materialise(deg.select("node", "i", (1 / F.sqrt(F.col("all") + 1.0)).alias("root"), F.col("later").cast("bigint").alias("deg")), "network-degrees")
        g.ids = deg.select("node", "i", "root")
        return g, deg.select("node", "deg")

    def _state(self, rows: DataFrame, width: int, kind: type) -> DataFrame:
        """Rows ``(i, v)``, v a number or list of them, as one packed row; 0 where there is none. One task holds ``width`` numbers a vertex."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.zeros((width, n), kind)
            for b in batches:
                x[:, b.column(0).to_numpy()] = _by_number(b.column(1), width)
            yield pa.RecordBatch.from_pydict({"state": pa.array([x.tobytes()], pa.binary())})

        return rows.select("i", "v").repartition(1).mapInArrow(run, "state binary")

    def _each(self, state: DataFrame | None, step: Callable, schema: str, width: int = 1, kind: type = np.int32) -> DataFrame:
        """The columns that ``step(own, counts, near[, state])`` gives for each piece."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in packed.rows_of(batches):
                more = [packed.numbers(r["state"], kind).reshape(width, n)] if "state" in r else []
                out = step(*(packed.numbers(r[c]) for c in ("own", "counts", "near")), *more)
                yield pa.RecordBatch.from_pydict({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in out.items()})

        rows = self.parts if state is None else self.parts.crossJoin(F.broadcast(state))
        return rows.mapInArrow(run, schema)

    def convolved(self, rows: DataFrame, width: int) -> DataFrame:
        """As the function: scaled by the root of the own degree, added up over the neighbours and the vertex itself, scaled again."""
        own = rows.join(self.ids, "node").select("node", "i", "root", F.transform("v", lambda x: x * F.col("root")).alias("v"))

        def add(own: np.ndarray, counts: np.ndarray, near: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
            at = np.cumsum(counts) - counts
            total = np.stack([np.add.reduceat(column[near], at) for column in x], 1)
            return {"i": own, "near": pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width, dtype=np.int32)), pa.array(total.ravel()))}

        near = self._each(self._state(own, width, np.float64), add, "i int, near array<double>", width, np.float64)
        total = F.transform("v", lambda x, j: F.col("root") * (x + F.coalesce(F.get("near", j), F.lit(0.0))))
        return own.join(near, "i", "left").select("node", total.alias("v"))

    def nearest(self, kept: DataFrame) -> DataFrame:
        ranks = materialise(placed(kept.select("node", "pick"), "v", F.col("pick"), first=1), "network-ranks")

        def greatest(own: np.ndarray, counts: np.ndarray, near: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
            best = np.maximum.reduceat(x[0][near], np.cumsum(counts) - counts)
            return {"i": own[best > 0], "v": best[best > 0]}

        best = self._each(self._state(ranks.join(self.ids, "node"), 1, np.int32), greatest, "i int, v int")
        return best.join(ranks.select("v", F.col("pick").alias("near")), "v").join(self.ids, "i").select("node", "near")

    def between(self, of: DataFrame) -> DataFrame:
        named = materialise(placed(of.select("cluster_id").where("cluster_id IS NOT NULL").distinct(), "v", F.col("cluster_id"), first=1), "network-clusters")

        def pairs(own: np.ndarray, counts: np.ndarray, near: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
            s, d = np.repeat(x[0][own], counts).astype(np.int64), x[0][near]
            key = (s << 32 | d)[(s != d) & (s > 0) & (d > 0)]  # 0: in no cluster
            key, w = np.unique(key, return_counts=True)
            return {"s": key >> 32, "d": key & 0xFFFFFFFF, "w": w}

        state = self._state(of.join(named, "cluster_id").join(self.ids, "node"), 1, np.int32)
        rows = self._each(state, pairs, "s bigint, d bigint, w bigint").groupBy("s", "d").agg(F.sum("w").alias("w"))
        a, b = named.select(F.col("v").alias("s"), F.col("cluster_id").alias("a")), named.select(F.col("v").alias("d"), F.col("cluster_id").alias("b"))
        return rows.join(a, "s").join(b, "d").select(F.col("a").alias("s"), F.col("b").alias("d"), "w")


@dataclass
class Graph:
    """What a network is trained on: ``nodes(node, x, y, role)``, the graph between them and their out-degrees."""

    nodes: DataFrame
    held: Rows | Packed
    degrees: DataFrame
    inputs: int
    classes: int
    training: int


def prepared(vertices: DataFrame, edges: DataFrame, features: DataFrame, labels: DataFrame, split: DataFrame, hidden: int) -> Graph:
    nodes = vertices.select("node").distinct().join(features, "node").join(labels.select("node", "label"), "node").join(split.select("node", "role"), "node")
    nodes = nodes.select("node", F.col("vector").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"), "role")
    nodes = materialise(nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "network-nodes")
    facts = nodes.agg(F.max(F.size("x")).alias("f"), F.max("y").alias("c"), F.count_if(F.col("role") == "train").alias("n"), F.count(F.lit(1)).alias("rows"), F.countDistinct("node").alias("nodes")).first()
    own, m = nodes.select("node"), edges.count()
    # a packed state holds a vector for each vertex, and a vertex once
    fits = facts["rows"] == facts["nodes"] and facts["rows"] * hidden <= packed.VERTICES
    if fits and m >= PACK_EDGES and packed.dense(own, m):
        held, degrees = Packed.of(own, edges, facts["rows"], m)
    else:
        held, degrees = Rows.of(own, edges)
    return Graph(nodes, held, degrees, facts["f"] or 0, (facts["c"] or 0) + 1, facts["n"] or 0)


@dataclass
class Pools:
    """Clusters of the vertices: ``of(node, cluster_id)``, their sizes and links."""

    of: DataFrame
    sizes: DataFrame
    links: DataFrame


def pools(g: Graph, partition: DataFrame) -> Pools:
    """A partition of all vertices; edges between clusters weigh as many as there are, both ways."""
    of = materialise(partition.select("node", "cluster_id"), "network-pools")
    sizes = of.groupBy(F.col("cluster_id").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return Pools(of, materialise(sizes, "network-sizes"), materialise(links(sizes.select("node"), materialise(g.held.between(of), "network-between")), "network-pool-links"))


def top_k(g: Graph, scores: DataFrame, k: int) -> DataFrame:
    """``(node, cluster_id)``: the k vertices of greatest ``scores(node, score)`` (ties to the lower id) are clusters, numbered in that
    order; any other vertex joins the adjacent one of greatest out-degree (then lower id), or that of all if it has none."""
    kept = placed(scores.orderBy(F.desc("score"), "node").limit(k), "cluster_id", F.desc("score"), F.col("node")).join(g.degrees, "node")
    kept = materialise(kept.select("node", "cluster_id", F.struct("deg", (-F.col("node")).alias("low"), "cluster_id").alias("pick")), "network-kept")
    near = g.held.nearest(kept)
    most = kept.agg(F.max("pick").alias("most"))
    rows = g.nodes.select("node").join(kept.select("node", "cluster_id"), "node", "left").join(near, "node", "left").crossJoin(F.broadcast(most))
    return rows.select("node", F.coalesce("cluster_id", "near.cluster_id", "most.cluster_id").alias("cluster_id"))


def _gated(z: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    x1 = np.maximum(z + w.first_bias, 0)
    return x1, np.tanh(x1 @ w.score)[:, None]


def forward(g: Graph, w: Weights, clusters: Pools | int) -> tuple[DataFrame, DataFrame, Pools]:
    """``(node, y, role, cluster_id, z, v)``, z before the first nonlinearity and v the logits; the clusters' vectors; the clusters."""
    shared = g.nodes.sparkSession.sparkContext.broadcast(w)  # the weights: bounded by the model
    hidden, classes = w.score.size, g.classes
    vector = "v array<double>"
    node = g.nodes.schema["node"].dataType.simpleString()
    h = _each(g.nodes.select("node", "x"), lambda b: pd.DataFrame({"node": b["node"], "v": list(_array(b["x"], 0) @ shared.value.first)}), f"node {node}, {vector}")
    z = materialise(g.held.convolved(h, hidden), "network-hidden")
    if not isinstance(clusters, Pools):
        scores = _each(z, lambda b: pd.DataFrame({"node": b["node"], "score": _gated(_array(b["v"], 0), shared.value)[0] @ shared.value.score}), f"node {node}, score double")
        clusters = pools(g, top_k(g, scores, clusters))
    rows = g.nodes.select("node", "y", "role").join(z.withColumnRenamed("v", "z"), "node").join(clusters.of, "node")
    rows = materialise(rows.select("node", "y", "role", "cluster_id", "z"), "network-rows")

    def gate(b: pd.DataFrame) -> pd.DataFrame:
        x1, t = _gated(_array(b["z"], 0), shared.value)
        return pd.DataFrame({"cluster_id": b["cluster_id"], "v": list(x1 * t)})

    mean = summed(_each(rows.select("cluster_id", "z"), gate, f"cluster_id bigint, {vector}"), "cluster_id", hidden).withColumnRenamed("cluster_id", "node")
    mean = mean.join(clusters.sizes, "node").select("node", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    mean = materialise(mean, "network-means")
    hp = _each(mean, lambda b: pd.DataFrame({"node": b["node"], "v": list(_array(b["v"], 0) @ shared.value.pooled)}), f"node bigint, {vector}")
    up = convolved(clusters.links, hp, classes).select(F.col("node").alias("cluster_id"), F.col("v").alias("up"))

    def logits(b: pd.DataFrame) -> pd.DataFrame:
        x1, _ = _gated(_array(b["z"], 0), shared.value)
        out = _array(b["up"], 0) + shared.value.pooled_bias + x1 @ shared.value.skip + shared.value.skip_bias
        return b.drop(columns="up").assign(v=list(out))

    out = _each(rows.join(up, "cluster_id").select("node", "y", "role", "cluster_id", "z", "up"), logits, f"node {node}, y int, role string, cluster_id bigint, z array<double>, {vector}")
    return materialise(out, "network-logits"), mean, clusters


def backward(g: Graph, w: Weights, rows: DataFrame, mean: DataFrame, clusters: Pools) -> Weights:
    """The gradient of the mean cross-entropy over the training rows."""
    shared, n = rows.sparkSession.sparkContext.broadcast(w), max(1, g.training)
    hidden, classes = w.score.size, g.classes

    def slope(b: pd.DataFrame) -> np.ndarray:
        v = _array(b["v"], 0)
        p = np.exp(v - v.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(b)), b["y"].to_numpy(int)] -= 1
        return np.where((b["role"] == "train").to_numpy()[:, None], p, 0) / n

    by_cluster = summed(_each(rows.where("role = 'train'").select("cluster_id", "y", "role", "v"), lambda b: pd.DataFrame({"cluster_id": b["cluster_id"], "v": list(slope(b))}), "cluster_id bigint, v array<double>"), "cluster_id", classes)
    sent = convolved(clusters.links, by_cluster.withColumnRenamed("cluster_id", "node"), classes)
    back = materialise(sent.join(mean.withColumnRenamed("v", "mean"), "node").join(clusters.sizes, "node"), "network-back")
    pooled = _total(back, lambda b: (_array(b["mean"], 0).T @ _array(b["v"], 0)).ravel(), hidden * classes)
    to_mean = _each(back, lambda b: pd.DataFrame({"cluster_id": b["node"], "down": list(_array(b["v"], 0) @ shared.value.pooled.T / b["n"].to_numpy()[:, None])}), "cluster_id bigint, down array<double>")
    # clusters that no gradient reaches have no row
    m = rows.join(to_mean, "cluster_id", "left").withColumn("down", F.coalesce("down", F.array_repeat(F.lit(0.0), hidden)))
    m = materialise(m.select("node", "y", "role", "z", "v", "down"), "network-down")

    def parts(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        own, z, down = shared.value, _array(b["z"], 0), _array(b["down"], 0)
        x1, t = _gated(z, own)
        s = slope(b)
        inner = (down * x1).sum(1, keepdims=True) * (1 - t**2)
        dx = down * t + inner * own.score + s @ own.skip.T
        return x1, s, inner, dx * (z + own.first_bias > 0)

    def own(b: pd.DataFrame) -> np.ndarray:
        x1, s, inner, dz = parts(b)
        return np.concatenate([dz.sum(0), (inner * x1).sum(0), s.sum(0), (x1.T @ s).ravel()])

    first_bias, score, bias, skip = np.split(_total(m, own, 2 * hidden + classes + hidden * classes), np.cumsum([hidden, hidden, classes]))
    node = g.nodes.schema["node"].dataType.simpleString()
    dz = _each(m, lambda b: pd.DataFrame({"node": b["node"], "v": list(parts(b)[3])}), f"node {node}, v array<double>")
    dh = g.held.convolved(dz, hidden).join(g.nodes.select("node", "x"), "node")
    first = _total(dh, lambda b: (_array(b["x"], 0).T @ _array(b["v"], 0)).ravel(), g.inputs * hidden)
    return Weights(first.reshape(-1, hidden), first_bias, score, pooled.reshape(hidden, -1), bias, skip.reshape(hidden, -1), bias.copy())


def measures(rows: DataFrame) -> tuple[float, float]:
    """Mean cross-entropy over the training rows, and accuracy on the rows of role ``val`` (of all if there are none)."""
    top = F.array_max("v")
    shifted = F.aggregate(F.transform("v", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    hit = (F.array_position("v", top) - 1 == F.col("y")).cast("double")
    r = rows.agg(F.avg(F.when(F.col("role") == "train", F.log(shifted) + top - F.get("v", F.col("y")))).alias("loss"), F.avg(F.when(F.col("role") == "val", hit)).alias("val"), F.avg(hit).alias("all")).first()
    return r["loss"] or 0.0, (r["val"] if r["val"] is not None else r["all"]) or 0.0


def train(vertices: DataFrame, edges: DataFrame, features: DataFrame, labels: DataFrame, split: DataFrame, clusters: DataFrame | int, hidden: int = 64, rounds: int = 300,
          rate: float = 0.01, decay: float = 5e-4, patience: int = 50, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``(node, label, pred, role)`` at the weights of greatest validation accuracy, and the loss before each step.

    ``clusters``: a partition ``(node, cluster_id)`` of all vertices, or the number of vertices kept by top-k pooling.
    """
    g = prepared(vertices, edges, features, labels, split, hidden)
    fixed = clusters if isinstance(clusters, int) else pools(g, clusters)
    w = Weights.drawn(g.inputs, hidden, g.classes, seed)
    flat = w.flat()
    m, s, losses, best, kept, since = np.zeros_like(flat), np.zeros_like(flat), [], -1.0, None, 0
    for t in range(1, rounds + 2):
        rows, mean, now = forward(g, w, fixed)
        loss, score = measures(rows)
        losses.append(loss)
        if score > best:
            best, kept, since = score, rows, 0
        elif (since := since + 1) >= patience:
            break
        if t > rounds or not g.training:
            break
        slope = backward(g, w, rows, mean, now).flat() + decay * flat
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope * slope
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w = w.like(flat)
    return kept.select("node", F.col("y").alias("label"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("pred"), "role"), losses
