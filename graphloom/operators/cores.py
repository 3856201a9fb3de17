"""k-cores, core numbers and the core forest (survey G7, G18, G19, G23).

Core numbers of a graph of up to ``ONE_TASK_EDGES`` edges come from the peel, in one task for each large component.
Beyond it every vertex starts at its degree, and the graph is cut into regions that hang together (``regions``). Each task
settles its region: with the numbers of the vertices around it held fixed, it peels its own vertices to the greatest numbers
that they allow. Only numbers that fell are exchanged, and only regions that see one of them are settled again. A fall that
runs along a chain thus crosses a region in one round. Vertices of more than ``REGION_EDGES`` edges are in no region: their
neighbours are counted by their numbers, with partial aggregation. A dense graph is packed first (``packed``), and every round takes
every vertex to the greatest number that its neighbours carry; should long chains hold it up, regions go on from there. All ways
give the same numbers.

The components of the k-cores, for all k, come from halving the range of k: the edges of level k and more (an edge's level is
the lesser core number of its ends) are contracted to components, which are the components of the k-core; edges of higher
levels go on uncontracted in the upper half of the range, edges of lower levels between the components in the lower half.
Every edge is in one of the two, so each of the log2(range) steps handles at most all edges once.

Defined results: null ends and loops count for nothing, nor do edges to vertices outside the table where one is given; null vertices
are left out, repeated ones count once; repeated edges count as often as they stand (``graph.simple``
merges them). Vertices without edges have core 0 and are in no k-core for k > 0. An empty graph gives empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.ranks import number
from graphloom.functions.storage import materialise
from graphloom.operators import packed
from graphloom.operators.components import component_roots, spanning, thinned
from graphloom.operators.graph import degree, induced, proper, symmetrise
from graphloom.operators.peel import adjacency, peel_arrays, peel_by_component
from graphloom.operators.regions import regions

#: Edges up to which a graph is pruned or peeled in one task.
ONE_TASK_EDGES = 1_000_000
#: Edge ends in a region.
REGION_EDGES = 500_000
#: Rounds on a packed graph after which regions go on.
PACKED_ROUNDS = 100
#: A k-core is pruned round by round as long as a round drops so large a share of the edges.
WORTH = 0.1
#: Edges of the core forest that one task finishes.
FINISH_EDGES = 1_000_000
#: Bits of a vertex number, beside those of a level, in the core forest.
ID_BITS = 40


def _last_core(k: int):
    """The vertices of the k-core of all edges ``(s, d)`` (both directions) of the batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            nodes, off, adj = adjacency(pd.concat(held, ignore_index=True))
            order, deg = peel_arrays(off, adj)
            core = pd.Series(deg).cummax().to_numpy()
            yield pd.DataFrame({"node": nodes[order[core >= k]]})

    return run


def kcore(edges: DataFrame, k: int) -> DataFrame:
    """``(node)`` of the k-core. Each round drops the vertices below k and their edges, until none is dropped or one
    task can finish what is left; if a round drops little, what is left goes the way of the core numbers."""
    live = materialise(edges.select("src", "dst").where("src <> dst"), "kcore")
    n = live.count()
    while n > ONE_TASK_EDGES:
        keep = symmetrise(live).groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") >= k)
        keep = materialise(keep.select("node"), "kcore-nodes")  # its size known, it goes to the edges while it is small
        live = materialise(induced(live, keep), "kcore")
        left = live.count()
        if left == n:
            return symmetrise(live).select(F.col("s").alias("node")).distinct()
        if left > n * (1 - WORTH) and left > ONE_TASK_EDGES:
            ends = symmetrise(live).select(F.col("s").alias("node")).distinct()
            return core_rounds(ends, live).where(F.col("core") >= k).select("node")
        n = left
    return symmetrise(live).coalesce(1).mapInPandas(_last_core(k), "node bigint")


def settled(off: list[int], adj: list[int], own: int, value: list[int]) -> list[int]:
    """The core numbers of the vertices below ``own`` when each of the others keeps its ``value``.

    ``off`` and ``adj`` list the neighbours of all: a peel in which the others leave at their value, whatever they lose.
    """
    n = len(value)
    key = [off[v + 1] - off[v] if v < own else value[v] for v in range(n)]
    heap = [k << 32 | v for v, k in enumerate(key)]
    heapq.heapify(heap)
    pop, push, mask = heapq.heappop, heapq.heappush, (1 << 32) - 1
    gone, out, level = bytearray(n), [0] * own, 0
    while heap:
        at = pop(heap)
        v = at & mask
        if gone[v] or at >> 32 != key[v]:
            continue
        gone[v] = 1
        level = max(level, key[v])
        if v < own:
            out[v] = level
        for w in adj[off[v] : off[v + 1]]:
            if w < own and not gone[w]:
                key[w] -= 1
                push(heap, key[w] << 32 | w)
    return out


def _settle(links: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """A region's edges ``(s, d)`` and the numbers of its own vertices and of those around: the own ones that fall."""
    values = values.sort_values(["own", "node"], ascending=[False, True], kind="stable")
    own = int(values["own"].sum())
    nodes = values["node"].to_numpy(np.int64)
    by = np.argsort(nodes, kind="stable")
    place = lambda c: by[np.searchsorted(nodes, links[c].to_numpy(np.int64), sorter=by)]
    s, d = place("s"), place("d")
    around = d >= own  # seen from here only, so their side of the edge is added
    s, d = np.concatenate([s, d[around]]), np.concatenate([d, s[around]])
    off = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(nodes)))])
    now = settled(off.tolist(), d[np.argsort(s, kind="stable")].tolist(), own, values["value"].tolist())
    out = pd.DataFrame({"node": nodes[:own], "now": now})
    return out[out["now"].to_numpy() < values["value"].to_numpy()[:own]]


def _hubs_fall(links: DataFrame, core: DataFrame) -> DataFrame:
    """``(node, now)`` of the hubs whose neighbours' numbers no longer carry theirs: the greatest h such that h of them
    stand at h or more. A hub is as many rows as there are different numbers around it."""
    near = links.join(core.select(F.col("node").alias("s"), F.col("value").alias("own")), "s").join(core.select(F.col("node").alias("d"), "value"), "d")
    counts = near.groupBy("s", "own", F.least("value", "own").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("s").orderBy(F.desc("c")))
    best = counts.withColumn("h", F.least("c", upto)).groupBy("s", "own").agg(F.max("h").alias("h"))
    return best.where("h < own").select(F.col("s").alias("node"), F.col("h").alias("now"))


def core_rounds(vertices: DataFrame, edges: DataFrame, region_edges: int | None = None) -> DataFrame:
    """``(node, core)`` by settling regions in turns, a dense graph's after rounds on its packed form."""
    size, start = REGION_EDGES if region_edges is None else region_edges, None
    if region_edges is None and (n := edges.count()) > ONE_TASK_EDGES and packed.dense(vertices, n):
        start, final = packed.core_numbers(vertices, edges, n, PACKED_ROUNDS)
        if final:
            return start
    own, plain = proper(vertices, edges)
    plain = materialise(plain, "core-edges")
    core = materialise(degree(own, plain).select("node", F.col("deg").alias("value")), "cores")
    hubs = core.where(F.col("value") > size)
    bound = plain.join(hubs.select(F.col("node").alias("src")), "src", "left_anti").join(hubs.select(F.col("node").alias("dst")), "dst", "left_anti")
    placed = regions(core.withColumnRenamed("value", "weight"), bound, size)
    # vertices that hang on hubs only stand anywhere
    others = core.where((F.col("value") > 0) & (F.col("value") <= size)).join(placed, "node", "left_anti")
    bins = max(1, -(-(others.agg(F.sum("value")).first()[0] or 0) // size))
    where = materialise(placed.unionByName(others.select("node", (-(1 << 62) + F.pmod(F.xxhash64("node"), F.lit(bins))).alias("region"))), "core-regions")
    both = symmetrise(plain)
    links = materialise(both.join(where.select(F.col("node").alias("s"), "region"), "s").select("region", "s", "d"), "core-links")
    mine = where.select(F.col("node").alias("d"), F.col("region").alias("home"))
    around = links.join(mine, "d", "left").where(~F.col("region").eqNullSafe(F.col("home"))).select("region", F.col("d").alias("node")).distinct()
    around = materialise(around, "core-around")
    at_hubs = materialise(both.join(hubs.select(F.col("node").alias("s")), "s", "left_semi"), "core-hubs")
    has_hubs = not at_hubs.isEmpty()
    if start is not None:
        core = start.withColumnRenamed("core", "value")
    active = None
    while True:
        only = (lambda df: df) if active is None else (lambda df, a=active: df.join(a, "region", "left_semi"))
        values = only(where).withColumn("own", F.lit(True)).unionByName(only(around).select("node", "region", F.lit(False).alias("own"))).join(core, "node")
        lower = only(links).groupBy("region").cogroup(values.groupBy("region")).applyInPandas(lambda a, b: _settle(a, b), "node bigint, now bigint")
        if has_hubs:
            lower = lower.unionByName(_hubs_fall(at_hubs, core))
        lower = materialise(lower, "cores-lower")
        if lower.isEmpty():
            break
        core = materialise(core.join(lower, "node", "left").select("node", F.coalesce("now", "value").alias("value")), "cores")
        active = materialise(around.join(lower, "node", "left_semi").select("region").distinct(), "cores-active")
        if not has_hubs and active.isEmpty():
            break
    return core.select("node", F.col("value").alias("core"))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All levels of the edges of a few ranges, from the top down, by joining sets."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    e = pd.concat(held, ignore_index=True)
    e = e.sort_values("level", ascending=False, kind="stable")
    lo = e["lo"].to_numpy(np.int64) << ID_BITS
    ids, at = np.unique(np.concatenate([lo | e["u"].to_numpy(np.int64), lo | e["v"].to_numpy(np.int64)]), return_inverse=True)
    size = np.ones(len(ids), np.int64)
    size[at] = np.concatenate([e["su"].to_numpy(np.int64), e["sv"].to_numpy(np.int64)])
    up, size, level = list(range(len(ids))), size.tolist(), e["level"].tolist()
    ks, roots, sizes = [], [], []
    formed: set[int] = set()

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def emit(k: int) -> None:
        for r in {find(x) for x in formed}:
            ks.append(k)
            roots.append(r)
            sizes.append(size[r])
        formed.clear()

    half = len(e)
    for i, k in enumerate(level):
        if i and k != level[i - 1]:
            emit(level[i - 1])
        a, b = find(int(at[i])), find(int(at[half + i]))
        if a != b:
            if size[a] < size[b]:
                a, b = b, a
            up[b] = a
            size[a] += size[b]
        formed.add(a)
    emit(level[-1])
    yield pd.DataFrame({"k": ks, "id": ids[roots] & ((1 << ID_BITS) - 1), "size": sizes})


def core_forest(core: DataFrame, edges: DataFrame) -> DataFrame:
    """``(k, root, size)``: the components of the k-cores, of vertices ``core(node, core)``; ``root`` is one of the members.

    A component that is the same at several k stands at the greatest of them, and may stand at others. Sizes count vertices. Of many
    edges each task keeps a spanning forest of the greatest levels, which connects at every level what they connect. Once
    ``FINISH_EDGES`` edges are left, one task joins them from the top level down.
    """
    spark = edges.sparkSession
    ids = materialise(number(core.where(F.col("core") > 0), "node", "id"), "forest-ids")
    end = lambda c, i, k: ids.select(F.col("node").alias(c), F.col("id").alias(i), F.col("core").alias(k))
    one = F.lit(1).cast("bigint")
    live = edges.where("src <> dst").join(end("src", "u", "cu"), "src").join(end("dst", "v", "cv"), "dst")
    if edges.count() > FINISH_EDGES:
        live = live.select("u", "v", F.least("cu", "cv").alias("level"))
        live = live.mapInPandas(thinned(spanning), "u bigint, v bigint, level bigint").select("u", "v", F.col("level").alias("cu"), F.col("level").alias("cv"))
    live = live.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max(F.least("cu", "cv")).alias("level"))
    top = core.agg(F.max("core")).first()[0] or 0
    live = materialise(live.select(one.alias("lo"), F.lit(top).cast("bigint").alias("hi"), "u", "v", "level", one.alias("su"), one.alias("sv")), "forest-edges")
    # a vertex of a range of levels, in one number: ranges are told by their lower end
    of = lambda c: F.shiftleft("lo", ID_BITS).bitwiseOR(F.col(c))
    found = spark.createDataFrame([], "k bigint, id bigint, size bigint")
    while (left := live.count()) > 0:
        if left <= FINISH_EDGES:
            found = found.unionByName(live.coalesce(1).mapInPandas(_forest, "k bigint, id bigint, size bigint"))
            break
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2)
        upper = live.where(F.col("level") >= mid).select(of("u").alias("a"), of("v").alias("b"), "su", "sv", mid.alias("k"))
        roots = materialise(component_roots(upper.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "forest-roots")
        ends = upper.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("su").alias("n"), "k"), F.struct(F.col("b").alias("node"), F.col("sv").alias("n"), "k")))).distinct()
        sizes = materialise(ends.join(roots, "node").groupBy("root").agg(F.sum("n").alias("size"), F.first("k").alias("k")), "forest-sizes")
        found = found.unionByName(sizes.select("k", F.col("root").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id"), "size"))
        into = materialise(roots.join(sizes, "root").select("node", F.col("root").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("id"), "size"), "forest-into")
        to = lambda c: into.select(F.col("node").alias(f"n{c}"), F.col("id").alias(f"r{c}"), F.col("size").alias(f"z{c}"))
        low = live.where(F.col("level") < mid).withColumns({"a": of("u"), "b": of("v"), "hi": mid - 1})
        low = low.join(to("u"), F.col("a") == F.col("nu"), "left").join(to("v"), F.col("b") == F.col("nv"), "left")
        low = low.select("lo", "hi", F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"), "level", F.coalesce("zu", "su").alias("su"), F.coalesce("zv", "sv").alias("sv"))
        turned = F.col("u") > F.col("v")
        pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
        low = low.where("u <> v").select("lo", "hi", pick("u", "v"), pick("v", "u"), "level", pick("su", "sv"), pick("sv", "su"))
        low = low.groupBy("lo", "hi", "u", "v", "su", "sv").agg(F.max("level").alias("level"))
        high = live.where(F.col("level") > mid).withColumn("lo", mid + 1)
        live = materialise(low.unionByName(high, allowMissingColumns=False).select(*live.columns), "forest-edges")
    return found.join(ids, "id").select("k", F.col("node").alias("root"), "size")


def largest_components(core: DataFrame, edges: DataFrame) -> DataFrame:
    """``(k, size)``: the size of the largest component of every k-core that is not empty, k from 1."""
    top = core_forest(core, edges).groupBy("k").agg(F.max("size").alias("size"))
    ks = core.agg(F.max("core").alias("top")).where("top > 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "top")).alias("k"))
    # a component of a k-core is one of the k-cores below, or part of a larger one; a row for each k
    later = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ks.join(top, "k", "left").select("k", F.max("size").over(later).alias("size"))


def rmc(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Greatest size times least internal degree over connected sets: over the components of the k-cores, size times k."""
    return core_forest(core, edges).agg(F.coalesce(F.max(F.col("k") * F.col("size")), F.lit(0)).cast("bigint").alias("rmc"))


def rmc_members(core: DataFrame, edges: DataFrame) -> DataFrame:
    """``(k, node)`` of the best set: of equals the greatest k, then the component that holds the least vertex."""
    forest = core_forest(core, edges).withColumn("value", F.col("k") * F.col("size"))
    best = materialise(forest.groupBy("value", "k").agg(F.min("size").alias("size")).orderBy(F.desc("value"), F.desc("k")).limit(1), "rmc-best")
    inner = core.crossJoin(F.broadcast(best)).where("core >= k").select("node", "k", "size")
    roots = materialise(component_roots(induced(edges, inner)), "rmc-roots")
    named = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    chosen = named.join(best, F.col("n") == F.col("size")).orderBy("least").limit(1).select("root", "k")
    return roots.join(F.broadcast(chosen), "root").select("k", "node")


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, core)`` of every vertex."""
    if edges.count() > ONE_TASK_EDGES:
        return core_rounds(vertices, edges)
    return peel_by_component(vertices, edges).select("node", "core")


def core_sweep(vertices: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """``(k, size, n_edges, avg_deg)`` of every non-empty k-core from ``least`` on."""
    core = materialise(core_numbers(vertices, edges), "cores")
    ends = edges.join(core.select(F.col("node").alias("src"), F.col("core").alias("a")), "src").join(
        core.select(F.col("node").alias("dst"), F.col("core").alias("b")), "dst"
    )
    ks = lambda c: F.explode(F.sequence(F.lit(least).cast("bigint"), c))
    size = core.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("core") >= least).select("n", ks(F.col("core")).alias("k"))
    size = size.groupBy("k").agg(F.sum("n").alias("size"))
    m = ends.groupBy(F.least("a", "b").alias("core")).agg(F.count(F.lit(1)).alias("n")).where(F.col("core") >= least).select("n", ks(F.col("core")).alias("k"))
    m = m.groupBy("k").agg(F.sum("n").alias("n_edges"))
    return size.join(m, "k", "left").select("k", "size", F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges"), (F.coalesce("n_edges", F.lit(0)) * 2.0 / F.col("size")).alias("avg_deg"))


def best_kcore(vertices: DataFrame, edges: DataFrame, low: int = 3, high: int = 30) -> DataFrame:
    """The k-core of greatest average degree for k in [low, high], ties to the larger, then the larger k."""
    return core_sweep(vertices, edges, low).where(F.col("k") <= high).orderBy(F.desc("avg_deg"), F.desc("size"), F.desc("k")).limit(1)


def degeneracy(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The greatest core number."""
    return core_numbers(vertices, edges).agg(F.max("core").alias("degeneracy"))
