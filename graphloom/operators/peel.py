"""Min-degree peel, and what follows from it (survey G3, G6, G20-G23).

Defined results: null vertices are left out, repeated ones count once; loops, null ends and edges to vertices outside the table
count for nothing; repeated edges count as often as they stand. Empty graphs give empty results.

The peel removes the vertex of least (degree, id) again and again. It is sequential, but components do not
interact, so each is peeled in one kernel (NumPy adjacency, a heap; small ones together) and the global
order is the merge of the components' streams: at any time the stream with the least head goes on, which is the
order of the running maximum of each stream's keys. A large dense graph is packed (``packed``), and one kernel peels it whole, 4 bytes an
edge end and no heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.ranks import placed
from graphloom.functions.storage import materialise
from graphloom.operators import packed
from graphloom.operators.components import connected_components, least_labels
from graphloom.operators.graph import proper, symmetrise

_PEELED = "component bigint, local bigint, node bigint, deg bigint, core bigint, top_deg bigint, top_node bigint"
#: Width of the ranges of positions within which suffixes are summed.
RANGE = 1_000_000
#: Vertices in a batch of small components.
BATCH = 20_000
#: A graph of at most so many vertices and edges is one batch, and its components are found there.
ONE_BATCH = 2_000_000


def adjacency(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in id order, and CSR offsets and neighbours (by index), of rows ``(s, d)`` where d may be null."""
    nodes = np.unique(pdf["s"].to_numpy(np.int64))
    e = pdf[pdf["d"].notna()]
    s, d = np.searchsorted(nodes, e["s"].to_numpy(np.int64)), np.searchsorted(nodes, e["d"].to_numpy(np.int64))
    order = np.lexsort((d, s))
    return nodes, np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(nodes)))]), d[order]


def peel_arrays(off: np.ndarray, adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removal order (indices in id order are ids) and each vertex's degree when removed."""
    n = len(off) - 1
    deg = np.diff(off).tolist()
    # one number for (degree, id) compares faster than a pair
    heap = [d << 32 | v for v, d in enumerate(deg)]
    heapq.heapify(heap)
    pop, push, mask = heapq.heappop, heapq.heappush, (1 << 32) - 1
    order, at = [], []
    gone = bytearray(n)
    ends, flat = off.tolist(), adj.tolist()
    while heap:
        key = pop(heap)
        v = key & mask
        if gone[v] or key >> 32 != deg[v]:
            continue
        gone[v] = 1
        order.append(v)
        at.append(deg[v])
        for w in flat[ends[v] : ends[v + 1]]:
            if not gone[w]:
                d = deg[w] = deg[w] - 1
                push(heap, d << 32 | w)
    return np.array(order, np.int64), np.array(at, np.int64)


#: The degree of a vertex that is gone, and the vertices whose least degree is kept with the kernel (as a power of two).
GONE, WIDTH = 1 << 30, 9


def peel_packed(start: np.ndarray, count: np.ndarray, near: np.ndarray, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``peel_arrays``, of neighbours ``near[start : start + count]`` of each vertex, all of them at once."""
    n, width = len(count), 1 << WIDTH
    deg = np.full(-(-n // width) * width, GONE, np.int32)
    deg[:n] = count
    grid = deg.reshape(-1, width)
    least = grid.min(1) if n else np.empty(0, np.int32)
    order, at = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(n):
        b = int(least.argmin())
        row = grid[b]
        j = int(row.argmin())
        v = b << WIDTH | j
        order[t], at[t], row[j] = v, row[j], GONE
        if count[v]:
            w = near[start[v] : start[v] + count[v]]
            if repeats:
                np.subtract.at(deg, w, 1)
                left = deg[w]
            else:
                left = deg[w] - 1
                deg[w] = left
            np.minimum.at(least, w >> WIDTH, left)
        least[b] = row.min()
    return order, at


def whole_peel(batches: Iterator[pa.RecordBatch], n: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of all pieces of a graph, by vertex numbers: removal order, degrees at removal, the least of each vertex's component, whether edges repeat."""
    start, count, near = np.zeros(n, np.int64), np.zeros(n, np.int32), np.empty(ends, np.int32)
    label, used, repeats = np.arange(n), 0, False
    for r in packed.rows_of(batches):
        own, counts, part = (packed.numbers(r[c]) for c in ("own", "counts", "near"))
        start[own], count[own] = used + np.cumsum(counts) - counts, counts
        near[used : used + len(part)] = part
        used, repeats = used + len(part), repeats or r["repeats"].as_py()
        a, b = label[np.repeat(own, counts)], label[part]
        label = least_labels(n, a, b)[label]
    return *peel_packed(start, count, near[:used], repeats), label, repeats


def _peel_pieces(n: int, ends: int):
    """The pieces of a graph to the rows of ``peel_by_component``, by vertex numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, deg, label, _ = whole_peel(batches, n, ends)
        yield from pa.Table.from_pandas(_streams(label[order], order, deg, n), preserve_index=False).to_batches(100_000)

    return run


def components_of(pdf: pd.DataFrame) -> np.ndarray:
    """The component (named by its least node) of each node, in id order."""
    own = pdf[pdf["d"].isna()].sort_values("s")
    if own["component"].notna().all():
        return own["component"].to_numpy(np.int64)
    nodes, off, adj = adjacency(pdf)
    return nodes[least_labels(len(nodes), np.repeat(np.arange(len(nodes)), np.diff(off)), adj)]


def batched(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(batch, component, s, d)``: every directed edge with its component, and ``d`` null once for each vertex.

    Components do not interact, so small ones share a batch of about BATCH vertices (a kernel run costs far
    more than a small component); a component of BATCH vertices or more is a batch of its own. A small graph is one
    batch, with null components: the kernel finds them (``components_of``).
    """
    vertices, edges = proper(vertices, edges)
    if vertices.count() + edges.count() <= ONE_BATCH:
        none = F.lit(None).cast("bigint")
        known, both = vertices.select(F.col("node").alias("s")), symmetrise(edges).select("s", "d")
        return both.unionByName(known.select("s", none.alias("d"))).select(F.lit(0).cast("bigint").alias("batch"), none.alias("component"), "s", "d")
    comp = materialise(connected_components(vertices, edges), "components")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < BATCH).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, -(-small // BATCH))
    draw = F.xxhash64("component")
    batch = F.when(F.col("n") < BATCH, F.pmod(draw, F.lit(batches))).otherwise(-1 - F.pmod(draw, F.lit(1 << 62)))
    of = comp.join(sizes.withColumn("batch", batch).select("component", "batch"), "component").select("batch", "component", F.col("node").alias("s"))
    own = of.select("batch", "component", "s", F.lit(None).cast("bigint").alias("d"))
    return symmetrise(edges).join(of, "s").select("batch", "component", "s", "d").unionByName(own)


def apply_kernel(vertices: DataFrame, edges: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` on the rows of each batch. Memory of a task: one batch, so at most one large component."""
    return batched(vertices, edges).groupBy("batch").applyInPandas(kernel, schema)


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, off, adj = adjacency(pdf)
    order, deg = peel_arrays(off, adj)
    out = _streams(components_of(pdf)[order], order, deg, len(nodes))
    return out.assign(node=nodes[out["node"]], top_node=nodes[out["top_node"]])


def _streams(component: np.ndarray, order: np.ndarray, deg: np.ndarray, n: int) -> pd.DataFrame:
    """The rows of ``peel_by_component`` with vertices by number, from a removal order, its degrees and components."""
    n += 1
    out = pd.DataFrame({"component": component, "node": order, "deg": deg, "key": deg * n + order})
    by = out.groupby("component", sort=False)
    top = by["key"].cummax().to_numpy()
    return out.assign(local=by.cumcount() + 1, core=by["deg"].cummax(), top_deg=top // n, top_node=top % n)[
        ["component", "local", "node", "deg", "core", "top_deg", "top_node"]
    ]


def peel_by_component(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(component, local, node, deg, core, top_deg, top_node)``; ``core`` is the core number."""
    own, plain = proper(vertices, edges)
    m = plain.count()
    if m <= ONE_BATCH or not packed.dense(own, m):
        return apply_kernel(vertices, edges, _peel, _PEELED)
    ids = packed.numbered(own)
    rows = packed.pieces(ids, plain, m).coalesce(1).mapInArrow(_peel_pieces(ids.count(), 2 * m), _PEELED)
    rows = materialise(rows, "peeled")
    for c in ("component", "node", "top_node"):
        rows = rows.withColumnRenamed(c, "i").join(ids.withColumnRenamed("node", c), "i").drop("i")
    return rows.select("component", "local", "node", "deg", "core", "top_deg", "top_node")


def global_order(peeled: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 1), the place in the peel of the whole graph.

    The order of (degree, id, place in the component) is dealt out by ranges sampled from it, dense ids or hashed ones, and
    positions are counted within the ranges.
    """
    p = placed(peeled, "pos", F.col("top_deg"), F.col("top_node"), F.col("local"), first=1)
    return p.select("pos", "node", "deg", "component", "local", "core")


def peel_order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(pos, node, deg)`` of the whole graph."""
    return global_order(peel_by_component(vertices, edges)).select("pos", "node", "deg")


def oriented(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(earlier, later)``: edges from the end that the replay adds first (the one removed later)."""
    a, b = order.select(F.col("node").alias("src"), F.col("pos").alias("pa")), order.select(F.col("node").alias("dst"), F.col("pos").alias("pb"))
    e = edges.join(a, "src").join(b, "dst")
    first = F.col("pa") > F.col("pb")
    return e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("earlier"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("later"))


def suffixes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(pos, n, m)``: vertices and edges left before the pos-th removal."""
    return suffix_sums(global_order(peel_by_component(vertices, edges)))


def suffix_sums(order: DataFrame) -> DataFrame:
    """``suffixes`` of a known order ``(pos, node, deg)``."""
    # an edge vanishes with its first end, whose degree at removal counts exactly the edges that go then
    block = F.floor((F.col("pos") - 1) / RANGE)
    p = order.select("pos", "deg").withColumn("block", block)
    sums = p.groupBy("block").agg(F.sum("deg").alias("m"), F.count(F.lit(1)).alias("n"))
    every = W.orderBy(F.desc("block"))
    later = sums.select("block", (F.sum("m").over(every) - F.col("m")).alias("m_after"), (F.sum("n").over(every) - F.col("n")).alias("n_after"))
    w = W.partitionBy("block").orderBy(F.desc("pos"))
    return p.join(later, "block").select(
        "pos", (F.row_number().over(w) + F.col("n_after")).alias("n"), (F.sum("deg").over(w) + F.col("m_after")).alias("m")
    )


def densest(vertices: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Best suffix of more than ``least`` vertices by average degree, ties to the larger: ``(pos, n, m, value)``."""
    s = suffixes(vertices, edges).where(F.col("n") > least).withColumn("value", F.col("m") * 2.0 / F.col("n"))
    return s.orderBy(F.desc("value"), F.desc("n")).limit(1)


def dense_suffix(vertices: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Best suffix of more than ``least`` vertices by edge density, ties (to 1e-12) to the larger."""
    s = suffixes(vertices, edges).where((F.col("n") > least) & (F.col("n") > 1))
    s = s.withColumn("value", F.col("m") * 2.0 / (F.col("n") * (F.col("n") - 1)))
    return s.orderBy(F.desc(F.round("value", 12)), F.desc("n")).limit(1)


def charikar_density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Best suffix by edges over vertices."""
    s = suffixes(vertices, edges).withColumn("value", F.col("m").cast("double") / F.col("n"))
    return s.orderBy(F.desc("value"), F.desc("n")).limit(1)


def suffix_members(order: DataFrame, best: DataFrame) -> DataFrame:
    """The vertices of a best suffix."""
    return order.crossJoin(F.broadcast(best.select(F.col("pos").alias("__from")))).where("pos >= __from").select("node")
