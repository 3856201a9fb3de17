"""Graphs cut into regions that hang together and fit a task.

Work that spreads from neighbour to neighbour runs far within a task before anything has to be exchanged, if neighbours
share a task. The graph is first contracted, as for connected components, until so few edges are left between its clusters
that one task can walk them; that task puts the clusters into the order of a walk and cuts the order into regions of about
equal weight. A cluster that outweighs a region is dealt over several by a hash.

Defined results: loops and edges with a null end count for nothing; vertices without edges have no region. An empty graph
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.storage import materialise
from graphloom.operators.components import FINISH_EDGES, contract

_SCHEMA = "root bigint, region bigint, parts bigint"


def walk(n: int, off: list[int], adj: list[int]) -> np.ndarray:
    """All vertices in the order of breadth-first walks, each begun at a vertex of least degree that is left."""
    degree = np.diff(off)
    seen, out = bytearray(n), []
    for first in np.argsort(degree, kind="stable").tolist():
        if seen[first]:
            continue
        seen[first] = 1
        at = len(out)
        out.append(first)
        while at < len(out):
            v = out[at]
            at += 1
            for w in adj[off[v] : off[v + 1]]:
                if not seen[w]:
                    seen[w] = 1
                    out.append(w)
    return np.array(out, np.int64)


def _cut(size: int):
    """Rows ``(u, v, null)`` of cluster edges and ``(u, null, weight)`` of clusters in; a region for each cluster out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        own, links = rows[rows["v"].isna()], rows[rows["v"].notna()]
        ids, at = np.unique(own["u"].to_numpy(np.int64), return_index=True)
        weight = own["weight"].to_numpy(np.float64)[at]
        u, v = (np.searchsorted(ids, links[c].to_numpy(np.int64)) for c in ("u", "v"))
        s, d = np.concatenate([u, v]), np.concatenate([v, u])
        by = np.argsort(s, kind="stable")
        off = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))])
        order = walk(len(ids), off.tolist(), d[by].tolist())
        begin = np.cumsum(weight[order]) - weight[order]
        region = (begin // size).astype(np.int64)
        parts = np.maximum(1, np.ceil(weight[order] / size)).astype(np.int64)
        yield pd.DataFrame({"root": ids[order], "region": region, "parts": parts})

    return run


def regions(weights: DataFrame, edges: DataFrame, size: int, finish: int = FINISH_EDGES) -> DataFrame:
    """``(node, region)`` of every end of an edge; ``weights(node, weight)`` add up to about ``size`` in a region."""
    labels, live = contract(edges, "src", "dst", finish)
    labels = materialise(labels.join(weights, "node", "left").select("node", "root", F.coalesce("weight", F.lit(1)).alias("weight")), "regions")
    clusters = labels.groupBy("root").agg(F.sum("weight").alias("weight"))
    ends = live.select(F.explode(F.array("u", "v")).alias("root")).distinct()
    none = F.lit(None)
    rows = live.select("u", "v", none.cast("double").alias("weight")).unionByName(
        clusters.join(ends, "root", "left_semi").select(F.col("root").alias("u"), none.cast("bigint").alias("v"), F.col("weight").cast("double").alias("weight"))
    )
    linked = rows.coalesce(1).mapInPandas(_cut(size), _SCHEMA)
    # clusters that are whole components stand together with others by a hash; negative numbers, to keep apart from the rest
    alone = clusters.join(ends, "root", "left_anti")
    bins = alone.agg(F.greatest(F.lit(1), F.ceil(F.sum("weight") / F.lit(size))).alias("bins"))
    alone = alone.crossJoin(F.broadcast(bins)).select(
        "root", (-1 - F.pmod(F.xxhash64("root"), F.coalesce("bins", F.lit(1)))).alias("region"), F.greatest(F.lit(1), F.ceil(F.col("weight") / size)).alias("parts")
    )
    of = linked.unionByName(alone)
    spread = F.pmod(F.xxhash64("node"), F.col("parts"))
    return labels.join(of, "root").select("node", F.when(F.col("region") < 0, F.col("region") - spread).otherwise(F.col("region") + spread).alias("region"))
