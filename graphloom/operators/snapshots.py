"""Replaying the peel backwards: snapshots of growing components (survey G7-G13, P1-P6).

Vertices are added in the reverse of the peel. Every addition makes one snapshot: the component that now
holds the vertex, with its size, sum of internal degrees and Laplacian energy
``Q = sum over internal edges of (d_u - d_v)^2``. A snapshot contains the last snapshots of the components
it joined, so snapshots form a forest with one node for each vertex, numbered depth-first: the members of a
snapshot are the vertices whose own number lies in its interval ``[tin, tout]``. That takes O(n) rows where
member arrays would take O(n^2).

Defined results: as for the peel (``peel``): null vertices are left out, repeated ones count once, loops and edges to vertices
outside the table count for nothing. Empty graphs give empty results.

``Q`` is kept as ``sum d^3 - 2 * sum over edges of d_u * d_v``; both sums add up over joined components.
"""

from __future__ import annotations

from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.ranks import number, placed, running_count
from graphloom.functions.storage import materialise
from graphloom.operators import packed, peel, replay
from graphloom.operators.graph import proper
from graphloom.operators.peel import adjacency, apply_kernel, components_of, peel_arrays

_SCHEMA = (
    "batch bigint, component bigint, sid bigint, node bigint, deg bigint, nc bigint, sum_deg bigint, q bigint, q_full bigint, parent bigint, tin bigint, tout bigint"
)


class _Components:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> tuple[int, int]:
        """(kept root, absorbed root)."""
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return a, b


#: Longer rings are summed by one call.
FEW = 6


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, off, adj = adjacency(pdf)
    order, at = peel_arrays(off, adj)
    n = len(nodes)
    full = np.diff(off)
    # neighbours in the order of addition: those present are always the first ones, as many as the degree so far
    added = np.empty(n, np.int64)
    added[order[::-1]] = np.arange(n)
    adj = adj[np.lexsort((added[adj], np.repeat(np.arange(n), full)))]
    flat, at_, start = adj.tolist(), at[::-1].tolist(), off.tolist()
    d, mark = [0] * n, bytearray(n)
    comps = _Components(n)
    find = comps.find
    cubes, prods, degs, fulls, last = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    nc, sum_deg, q, q_full = [0] * n, [0] * n, [0] * n, [0] * n
    parent = [-1] * n
    whole = full.tolist()
    for s, (u, k) in enumerate(zip(order[::-1].tolist(), at_)):
        root, gain = u, {}
        cubes[u], degs[u] = k * k * k, k
        if k:
            near = flat[start[u] : start[u] + k]
            for x in near:
                mark[x] = 1
            w = whole[u]
            f = k * w * w
            for x in near:
                a = d[x]
                ring = flat[start[x] : start[x] + a]  # x's present neighbours
                if a > FEW:
                    take = itemgetter(*ring)
                    near_sum, twice = sum(take(d)), sum(take(mark))
                else:
                    near_sum = twice = 0
                    for y in ring:
                        near_sum += d[y]
                        twice += mark[y]
                f += whole[x] * (whole[x] - 2 * w)
                r = find(x)
                # x's cube grows; its other edges grow by the degrees at their ends, and by one for an edge
                # between two neighbours (seen from both); the new edge is k * (a + 1)
                g = gain.get(r)
                if g is None:
                    gain[r] = [3 * a * (a + 1) + 1, near_sum + k * (a + 1), twice]
                else:
                    g[0] += 3 * a * (a + 1) + 1
                    g[1] += near_sum + k * (a + 1)
                    g[2] += twice
            for x in near:
                mark[x] = 0
                d[x] += 1
            d[u], fulls[u] = k, f
        for r, (c, p, twice) in gain.items():
            cubes[r] += c
            prods[r] += p + twice // 2
            parent[last[r]] = s
        for r in gain:
            a, b = comps.join(root, r)
            cubes[a] += cubes[b]
            prods[a] += prods[b]
            degs[a] += degs[b]
            fulls[a] += fulls[b]
            root = a
        degs[root] += k
        last[root] = s
        nc[s], sum_deg[s], q[s], q_full[s] = comps.size[root], degs[root], cubes[root] - 2 * prods[root], fulls[root]
    # depth-first numbers: children stand before their parent, so sizes and places come from two passes
    size, used, tin, free = [1] * n, [0] * n, [0] * n, 0
    for s in range(n):
        if parent[s] >= 0:
            size[parent[s]] += size[s]
    for s in range(n - 1, -1, -1):
        up = parent[s]
        if up < 0:
            tin[s], free = free, free + size[s]
        else:
            tin[s] = tin[up] + 1 + used[up]
            used[up] += size[s]
    comp = components_of(pdf)[order[::-1]]
    sid = pd.Series(comp).groupby(comp, sort=False).cumcount().to_numpy()  # additions counted within each component
    up = np.array(parent)
    return pd.DataFrame({
        "batch": pdf["batch"].iloc[0], "component": comp, "sid": sid, "node": nodes[order[::-1]], "deg": at[::-1],
        "nc": nc, "sum_deg": sum_deg, "q": q, "q_full": q_full, "parent": np.where(up >= 0, sid[up], -1), "tin": tin, "tout": np.array(tin) + np.array(size) - 1,
    })


def snapshots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each vertex: the snapshot made by adding it.

    ``sid`` counts additions within the component from 0; ``deg`` is the vertex's degree when removed;
    ``q_full`` is the energy with degrees of the whole graph in place of internal ones:
    ``sum d_C(i) * d(i)^2 - 2 * sum over internal edges of d(i) * d(j)``.
    """
    own, plain = proper(vertices, edges)
    if (m := plain.count()) > peel.ONE_BATCH and packed.dense(own, m) and (found := replay.replayed(own, plain, m)):
        rows = replay.named(found[0], found[1]).withColumn("batch", F.lit(0).cast("bigint"))
        return rows.select(*(c.split()[0] for c in _SCHEMA.split(", ")))
    return apply_kernel(vertices, edges, _replay, _SCHEMA)


#: Places of an interval that are unrolled at a time.
STRETCH = 65_536


def unrolled(chosen: DataFrame, keep: list[str]) -> DataFrame:
    """``(component, tin, *keep)``: a row for each vertex of each chosen snapshot (component, tin, tout), by its place.

    Intervals are unrolled in stretches, so a giant set is no giant array, and places are then found by equality: a component
    is no key by itself.
    """
    own = chosen.select("component", F.col("tin").alias("__lo"), F.col("tout").alias("__hi"), *(F.col(c) for c in keep))
    own = own.withColumn("__at", F.explode(F.sequence("__lo", "__hi", F.lit(STRETCH))))
    places = F.sequence("__at", F.least(F.col("__at") + (STRETCH - 1), "__hi"))
    return own.withColumn("tin", F.explode(places)).select("component", "tin", *keep)


def members(snaps: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(component, sid, node)``: the vertices of the chosen snapshots (component, sid, tin, tout)."""
    return unrolled(chosen, ["sid"]).join(snaps.select("component", "tin", "node"), ["component", "tin"]).select("component", "sid", "node")


def score(eps: float | Column, q: str = "q") -> Column:
    """Size over energy."""
    return F.col("nc") / (F.col(q) + eps)


def calibrated(alpha: Column | float, eps: float | Column) -> Column:
    """Size times (average internal degree - alpha * sqrt(Q + eps))."""
    return F.col("nc") * (F.col("sum_deg") / F.col("nc") - alpha * F.sqrt(F.col("q") + eps))


def rmc(snaps: DataFrame) -> DataFrame:
    """Greatest size times least internal degree over connected sets, from snapshots that are there anyway (``cores.rmc`` needs none).

    At its addition a vertex has the least degree of all vertices present, so size times that degree is
    reached by its component; and the last vertex of an optimal set sees all of the set.
    """
    return snaps.agg(F.coalesce(F.max(F.col("nc") * F.col("deg")), F.lit(0)).alias("rmc"))


def best(snaps: DataFrame, value: Column) -> DataFrame:
    """The one best snapshot: ties to the larger, then the lower component, then the earlier."""
    return snaps.withColumn("score", value).orderBy(F.desc("score"), F.desc("nc"), "component", "sid").limit(1)


def peak_per_component(snaps: DataFrame, value: Column) -> DataFrame:
    """Each component's best snapshot of two or more vertices."""
    s = snaps.where("nc > 1").withColumn("score", value)
    top = s.groupBy("component").agg(F.max(F.struct("score", "nc", -F.col("sid"))).alias("m"))
    top = top.select("component", (-F.col("m")["col3"]).alias("sid"))
    return s.join(top, ["component", "sid"])


def uncovered(vertices: DataFrame, covered: DataFrame) -> DataFrame:
    """The vertices outside all chosen sets: each is a cluster of its own."""
    return vertices.select("node").join(covered.select("node").distinct(), "node", "left_anti")


def best_above(snaps: DataFrame, key: Column) -> DataFrame:
    """``(component, sid, node, best)``: the greatest ``key`` of a snapshot and all that hold it; null keys do not count.

    Pointer doubling over the forest: every row looks up the row of its farthest ancestor so far, takes the greater key and
    that row's own farthest ancestor, so the number of rounds is the logarithm of the depth.
    """
    up = F.when(F.col("parent") >= 0, F.col("parent"))
    rows = materialise(snaps.select("component", "sid", "node", up.alias("up"), key.alias("best")), "best-above")
    while not (rest := rows.where("up IS NOT NULL")).isEmpty():
        above = rows.select(F.col("component").alias("c"), F.col("sid").alias("p"), F.col("up").alias("next"), F.col("best").alias("over"))
        risen = rest.join(above, (F.col("component") == F.col("c")) & (F.col("up") == F.col("p")))
        risen = risen.select("component", "sid", "node", F.col("next").alias("up"), F.greatest("best", "over").alias("best"))
        rows = materialise(rows.where("up IS NULL").unionByName(risen), "best-above")
    return rows.select("component", "sid", "node", "best")


def least_members(snaps: DataFrame) -> DataFrame:
    """``(component, sid, least)``: the least vertex of every snapshot.

    Doubling the other way: after j rounds a row knows the least vertex of the snapshots less than 2^j steps below it, and is
    told, as one minimum, what those 2^j steps below know.
    """
    up = F.when(F.col("parent") >= 0, F.col("parent"))
    rows = materialise(snaps.select("component", "sid", up.alias("up"), F.col("node").alias("least")), "least")
    while not (rest := rows.where("up IS NOT NULL")).isEmpty():
        told = rest.groupBy(F.col("component").alias("c"), F.col("up").alias("p")).agg(F.min("least").alias("below"))
        above = rows.select(F.col("component").alias("c2"), F.col("sid").alias("p2"), F.col("up").alias("next"))
        known = rows.join(told, (F.col("component") == F.col("c")) & (F.col("sid") == F.col("p")), "left")
        known = known.join(above, (F.col("component") == F.col("c2")) & (F.col("up") == F.col("p2")), "left")
        rows = materialise(known.select("component", "sid", F.col("next").alias("up"), F.least("least", "below").alias("least")), "least")
    return rows.select("component", "sid", "least")


def best_per_node(snaps: DataFrame, value: Column) -> DataFrame:
    """``(node, component, sid, score, nc)``: of the snapshots that hold a vertex the best (then larger, then earlier).

    A vertex's snapshots are the one that it made and that one's ancestors in the forest.
    """
    best = best_above(snaps, F.struct(value.alias("score"), "nc", (-F.col("sid")).alias("later")))
    return best.select("node", "component", (-F.col("best.later")).alias("sid"), "best.score", "best.nc")


def best_partition(chosen: DataFrame) -> DataFrame:
    """``(node, cluster_id)``: vertices with the same best snapshot, numbered by their least vertex."""
    first = chosen.groupBy("component", "sid").agg(F.min("node").alias("first"))
    return chosen.join(number(first, "first", "cluster_id"), ["component", "sid"]).select("node", "cluster_id")


def low_energy(snaps: DataFrame, share: float = 0.05, least: int = 50) -> DataFrame:
    """The snapshots of two or more vertices whose sqrt(Q) is at most the value at the cut rank.

    Over all snapshots sorted by energy, with i0 of energy 0, the cut is the value at rank
    ``i0 + max(least, floor(share * rest))`` (from 0; the last if beyond). Ranks are taken over the distinct
    energies' counts, never over all rows in one task.
    """
    counts = snaps.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    upto = running_count(counts, "q", "n")
    total = snaps.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("q") <= 0).alias("i0"))
    at = F.least(F.col("i0") + F.greatest(F.lit(least), F.floor(F.lit(share) * (F.col("all") - F.col("i0")))), F.col("all") - 1)
    cut = upto.crossJoin(F.broadcast(total)).where(F.col("upto") > at).agg(F.min("q").alias("cut"))
    return snaps.where("nc > 1").crossJoin(F.broadcast(cut)).where("q <= cut").drop("cut")


def ranked(snaps: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """``(rank, component, sid, score, nc)``, best first."""
    s = snaps.withColumn("score", value).select("component", "sid", "score", "nc", "tin", "tout")
    if limit is not None:
        s = s.orderBy(F.desc("score"), "component", "sid").limit(limit)
    return placed(s, "rank", F.desc("score"), F.col("component"), F.col("sid"), first=1)


def score_sweep(snaps: DataFrame, eps: list[float]) -> DataFrame:
    """Best size-over-energy for each epsilon, from one pass over the snapshots."""
    grid = snaps.select("nc", "q", F.explode(F.array(*map(F.lit, eps))).alias("eps"))
    return grid.groupBy("eps").agg(F.max(F.col("nc") / (F.col("q") + F.col("eps"))).alias("best_score"))


def calibrated_sweep(snaps: DataFrame, eps: list[float], alpha: list[float]) -> DataFrame:
    """Best calibrated score for each epsilon and constant alpha, from one pass over the snapshots."""
    grid = snaps.select("nc", "sum_deg", "q", F.explode(F.array(*map(F.lit, eps))).alias("eps"))
    grid = grid.withColumn("alpha", F.explode(F.array(*map(F.lit, alpha))))
    return grid.groupBy("eps", "alpha").agg(F.max(calibrated(F.col("alpha"), F.col("eps"))).alias("best_score"))


def _edge_replay(eps: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, off, adj = adjacency(pdf)
        order, _ = peel_arrays(off, adj)
        n = len(nodes)
        comps = _Components(n)
        joined: list[list[int]] = [[] for _ in range(n)]
        held = [[v] for v in range(n)]
        d, q, here = [0] * n, [0] * n, bytearray(n)
        comp = components_of(pdf)
        best: dict[int, tuple[float, int, np.ndarray]] = {}
        for u in order[::-1].tolist():
            here[u] = 1
            steps = [x for x in adj[off[u] : off[u + 1]].tolist() if here[x]]
            for x in [None, *steps]:
                if x is not None:
                    a, b = d[u], d[x]
                    grow = sum((a + 1 - d[y]) ** 2 - (a - d[y]) ** 2 for y in joined[u]) + sum((b + 1 - d[y]) ** 2 - (b - d[y]) ** 2 for y in joined[x])
                    d[u], d[x] = a + 1, b + 1
                    joined[u].append(x)
                    joined[x].append(u)
                    ru, rx = comps.find(u), comps.find(x)
                    if ru != rx:
                        k, g = comps.join(ru, rx)
                        q[k] += q[g]
                        held[k] += held[g]
                        held[g] = []
                    q[comps.find(u)] += grow + (a - b) ** 2
                r = comps.find(u)
                s = comps.size[r] / (q[r] + eps)
                if s > best.get(comp[u], (0.0,))[0]:
                    best[comp[u]] = s, comps.size[r], np.array(held[r])
        return pd.concat([pd.DataFrame({"component": c, "score": s, "size": k, "node": nodes[np.sort(m)]}) for c, (s, k, m) in best.items()])

    return run


def best_by_edge(vertices: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """Scoring after every single edge: the best set of each component, ``(component, score, size, node)``."""
    own, plain = proper(vertices, edges)
    if (m := plain.count()) > peel.ONE_BATCH and packed.dense(own, m) and (found := replay.best_by_edge(own, plain, m, eps)):
        spans, rows, ids = found
        sets = unrolled(spans, ["score", "size"]).join(rows.select("component", "tin", "i"), ["component", "tin"])
        return replay.named(sets, ids).select("component", "score", "size", "node")
    return apply_kernel(vertices, edges, _edge_replay(eps), "component bigint, score double, size bigint, node bigint")
