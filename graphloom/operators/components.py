"""Connected components by randomised edge contraction (survey G24, G33).

Each round every vertex hooks onto the neighbour (or itself) of least pseudorandom priority and the
edge list is rewritten onto the hooks. A fresh priority each round makes the expected number of live
vertices shrink by a constant factor even on long monotone paths, so rounds grow with log(n). All
steps are partial aggregations and joins; no vertex's neighbourhood is gathered in one place.

Defined results: loops and null ends count for nothing, repeated edges once. A repeated vertex has one row; a null one has a null
component. Edges may lead through vertices outside the table, and a component is named by the least vertex reached, inside or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.storage import materialise

#: Edges that a task thins out at a time, and that it holds at most.
THIN, HELD = 1_000_000, 4_000_000
#: Once so few edges are left, one task finishes them.
FINISH_EDGES = 1_000_000


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the vertices 0 .. n-1 the least one that the edges connect it with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = a[apart], b[apart]  # from now on between the labels only
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


def spanning(e: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of edges ``(u, v, level)`` that takes the greatest levels: at every level it connects the same vertices.

    Every cluster takes its best edge (levels, then a fixed order, so no circles), all at once, until none is left between two.
    """
    e = e.sort_values("level", ascending=False, kind="stable")
    ids, at = np.unique(e[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    rank, u, v, n, taken = np.arange(len(e)), at[:, 0], at[:, 1], len(ids), []
    while True:
        apart = u != v
        rank, u, v = rank[apart], u[apart], v[apart]
        if not len(rank):
            return e.iloc[np.sort(np.concatenate(taken))] if taken else e.iloc[:0]
        best = np.full(n, len(e))
        np.minimum.at(best, u, rank)
        np.minimum.at(best, v, rank)
        chosen = np.unique(best[best < len(e)])
        taken.append(chosen)
        by = np.searchsorted(rank, chosen)
        label = least_labels(n, u[by], v[by])
        u, v = label[u], label[v]


def stars(e: pd.DataFrame) -> pd.DataFrame:
    """Edges ``(u, v)`` as stars around the least vertex of each component."""
    ids, at = np.unique(e[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    label = least_labels(len(ids), at[:, 0], at[:, 1])
    far = label != np.arange(len(ids))
    return pd.DataFrame({"u": ids[label[far]], "v": ids[far]})


def thinned(thin: Callable[[pd.DataFrame], pd.DataFrame]):
    """Batches of edges to those that ``thin`` keeps of all of a task's, THIN more at a time. Where it keeps over HELD, it begins anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, fresh = [], 0
        for b in batches:
            held.append(b)
            fresh += len(b)
            if fresh >= THIN:
                held, fresh = [thin(pd.concat(held, ignore_index=True))], 0
                if len(held[0]) > HELD:
                    yield held.pop()
        if fresh or held:
            yield thin(pd.concat(held, ignore_index=True))

    return run


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b[["u", "v"]].to_numpy(np.int64) for b in batches if len(b)]
    if held:
        ids, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"id": ids, "hook": ids[least_labels(len(ids), at[:, 0], at[:, 1])]})


def contract(edges: DataFrame, src: str, dst: str, finish: int, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(node, root)`` of clusters that hang together, and the edges ``(u, v)`` left between their roots: at most ``finish``.

    Self-loops and rows with a null end are ignored.
    """
    live = materialise(
        edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        .distinct(),
        "cc-edges",
    )
    labels = live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    for turn in range(max_rounds):
        if live.count() <= finish:
            return labels, live
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))
        ends = live.select("u", rank("v").alias("r")).unionByName(live.select(F.col("v").alias("u"), rank("u").alias("r")))
        hooks = (
            ends.groupBy("u").agg(F.min("r").alias("r"))
            .select(F.col("u").alias("id"), F.least("r", rank("u"))["x"].alias("hook"))
        )
        hooks = materialise(hooks, "cc-hooks")
        labels = materialise(_relabel(labels, hooks), "cc-labels")
        hu = hooks.select(F.col("id").alias("u"), F.col("hook").alias("hu"))
        hv = hooks.select(F.col("id").alias("v"), F.col("hook").alias("hv"))
        live = materialise(
            live.join(hu, "u").join(hv, "v").where("hu <> hv")
            .select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct(),
            "cc-edges",
        )
    raise RuntimeError("connected components did not converge")


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, finish: int | None = None) -> DataFrame:
    """``(node, root)`` for every end of ``edges``; the ends of an edge share a root.

    The root is some member of the component (not always the least). Self-loops and rows with a null
    end are ignored; an empty edge table gives an empty result. Of many edges each task keeps as many as connect the same vertices.
    """
    finish = FINISH_EDGES if finish is None else finish
    if edges.count() > finish:
        ends = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u <> v")
        edges, src, dst = ends.mapInPandas(thinned(stars), "u bigint, v bigint"), "u", "v"
    labels, live = contract(edges, src, dst, finish, max_rounds)
    return _relabel(labels, live.coalesce(1).mapInPandas(_finish, "id bigint, hook bigint"))


def _relabel(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    h = hooks.select(F.col("id").alias("root"), "hook")
    return labels.join(h, "root", "left").select("node", F.coalesce("hook", "root").alias("root"))


def connected_components(vertices: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the least node id reachable; isolated vertices are their own component."""
    roots = component_roots(edges, src, dst)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("__n"), "least")
    return (
        vertices.select(F.col(node).cast("bigint").alias("node")).distinct()
        .join(named, F.col("node") == F.col("__n"), "left")
        .select("node", F.coalesce("least", "node").alias("component"))
    )
