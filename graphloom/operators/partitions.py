"""Partitions of the vertices: ``(node, cluster_id)`` relations, their coarsening and pooling (survey P7-P17).

Defined results: edges with an end in no cluster count for nothing. A null cluster is no cluster, and its vertices join none. Null
vertices in a partition are rows like others where clusters are counted. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.ranks import number, placed, running_count
from graphloom.functions.storage import materialise
from graphloom.operators.components import component_roots, connected_components
from graphloom.operators.graph import degree, symmetrise
from graphloom.operators.snapshots import best_above, unrolled


def last_wins(rows: DataFrame) -> DataFrame:
    """One cluster for each node of overlapping ``(node, cluster_id, ordinal)``: that of the greatest ordinal."""
    return rows.groupBy("node").agg(F.max_by("cluster_id", "ordinal").alias("cluster_id"))


def with_singletons(vertices: DataFrame, partition: DataFrame) -> DataFrame:
    """Every vertex outside the partition becomes a cluster of its own, numbered after the others by id."""
    top = partition.agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("top"))
    left = vertices.select("node").join(partition.select("node"), "node", "left_anti")
    single = number(left, "node", "k", first=1).crossJoin(F.broadcast(top)).select("node", (F.col("top") + F.col("k")).cast("bigint").alias("cluster_id"))
    return partition.select("node", "cluster_id").unionByName(single)


def check_cover(vertices: DataFrame, partition: DataFrame) -> None:
    missing = vertices.select("node").join(partition.select("node"), "node", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"vertex {missing[0]['node']} is in no cluster")


def _ends(edges: DataFrame, partition: DataFrame) -> DataFrame:
    a = partition.select(F.col("node").alias("src"), F.col("cluster_id").alias("a"))
    b = partition.select(F.col("node").alias("dst"), F.col("cluster_id").alias("b"))
    return edges.join(a, "src").join(b, "dst")


def cluster_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """``(cu, cv, weight)``, cu < cv: edges between two clusters."""
    e = _ends(edges, partition).where("a <> b")
    return e.select(F.least("a", "b").alias("cu"), F.greatest("a", "b").alias("cv")).groupBy("cu", "cv").agg(F.count(F.lit(1)).alias("weight"))


def cluster_pairs(edges: DataFrame, partition: DataFrame, both: bool = False) -> DataFrame:
    """Distinct adjacent cluster pairs, in one or both directions."""
    pairs = cluster_edges(edges, partition).select("cu", "cv")
    return pairs if not both else pairs.unionByName(pairs.select(F.col("cv").alias("cu"), F.col("cu").alias("cv")))


def pool_mean(partition: DataFrame, features: DataFrame) -> DataFrame:
    """``(cluster_id, j, value)``: mean of each component of ``features(node, vector)`` over a cluster."""
    long = partition.join(features, "node").select("cluster_id", F.posexplode("vector").alias("j", "x"))
    return long.groupBy("cluster_id", "j").agg(F.avg(F.col("x").cast("double")).alias("value"))


def pool_scalar(partition: DataFrame, values: DataFrame) -> DataFrame:
    """``(cluster_id, mean_value)`` of ``values(node, value)``."""
    return partition.join(values, "node").groupBy("cluster_id").agg(F.avg("value").alias("mean_value"))


def broadcast_back(partition: DataFrame, values: DataFrame) -> DataFrame:
    """A value of each cluster, on each of its vertices."""
    return partition.join(values, "cluster_id")


def size_statistics(partition: DataFrame) -> DataFrame:
    """One row: clusters, least, lower-median, mean and greatest size, share of singletons."""
    sizes = partition.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.min("size").alias("min_size"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").cast("bigint").alias("median_size"),
        F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.avg((F.col("size") == 1).cast("double")).alias("singleton_rate"),
    )


def mask_small(partition: DataFrame, values: DataFrame, least: int) -> DataFrame:
    """``(cluster_id, value)`` with 0 for clusters of fewer than ``least`` vertices."""
    sizes = partition.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return values.join(sizes, "cluster_id").select("cluster_id", F.when(F.col("size") >= least, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def target_count(n: int, ratio: float) -> int:
    return int(ratio * n + 0.999)


def compress(edges: DataFrame, partition: DataFrame, k: int) -> DataFrame:
    """At most ``k`` clusters: the k largest stay (ties to the lower id), each other joins the kept cluster
    with which it has most edges, ties and clusters without such edges going to the greatest kept id. What stays is numbered
    from 0 in the order of the ids, unless the ids already ended below ``k``."""
    sizes = partition.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    kept = materialise(sizes.orderBy(F.desc("size"), "cluster_id").limit(k).select("cluster_id"), "kept")
    top = kept.agg(F.max("cluster_id").alias("top"))
    numbers = kept.select(F.col("cluster_id").alias("to"), (F.row_number().over(W.orderBy("cluster_id")) - 1).cast("bigint").alias("place"))  # k rows
    ends = sizes.agg(F.max("cluster_id").alias("end"))
    w = cluster_edges(edges, partition)
    sym = w.select("cu", "cv", "weight").unionByName(w.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "weight"))
    near = sym.join(kept, sym["cv"] == kept["cluster_id"], "left_semi")
    best = near.groupBy(F.col("cu").alias("cluster_id")).agg(F.max(F.struct("weight", "cv"))["cv"].alias("to"))
    stay = kept.withColumn("stays", F.lit(True))
    move = sizes.select("cluster_id").join(stay, "cluster_id", "left").join(best, "cluster_id", "left").crossJoin(F.broadcast(top))
    move = move.select("cluster_id", F.when(F.col("stays"), F.col("cluster_id")).otherwise(F.coalesce("to", "top")).alias("to"))
    move = move.join(F.broadcast(numbers), "to").crossJoin(F.broadcast(ends))
    move = move.select("cluster_id", F.when(F.col("end") < k, F.col("to")).otherwise(F.col("place")).alias("to"))
    return partition.join(move, "cluster_id").select("node", F.col("to").alias("cluster_id"))


def top_degree(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k vertices of greatest degree (ties to the lower id) as centres; every other vertex joins the
    adjacent centre of greatest degree (then lower id), or the first centre if it has none."""
    deg = degree(vertices, edges)
    centres = materialise(
        deg.orderBy(F.desc("deg"), "node").limit(k).withColumn("cluster_id", (F.row_number().over(W.orderBy(F.desc("deg"), "node")) - 1).cast("bigint")), "centres"
    )
    near = symmetrise(edges).join(centres.select(F.col("node").alias("d"), "cluster_id"), "d").groupBy(F.col("s").alias("node")).agg(F.min("cluster_id").alias("near"))
    own = centres.select("node", F.col("cluster_id").alias("own"))
    return vertices.select("node").join(own, "node", "left").join(near, "node", "left").select("node", F.coalesce("own", "near", F.lit(0)).cast("bigint").alias("cluster_id"))


def merge_tiny(edges: DataFrame, partition: DataFrame, least: int, rounds: int = 8) -> DataFrame:
    """Clusters below ``least`` join the neighbour with which they have most edges (ties to the larger, then the
    lower id), up to ``rounds`` times; chains of joins end in one cluster, named by its least id."""
    part = partition
    for _ in range(rounds):
        sizes = part.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        w = cluster_edges(edges, part)
        sym = w.unionByName(w.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "weight"))
        tiny = sizes.where(F.col("size") < least).select(F.col("cluster_id").alias("cu"))
        goal = sym.join(tiny, "cu").join(sizes.select(F.col("cluster_id").alias("cv"), "size"), "cv")
        hook = goal.groupBy("cu").agg((-F.max(F.struct("weight", "size", (-F.col("cv")).alias("neg")))["neg"]).alias("cv"))
        hook = materialise(hook, "merge")
        if hook.isEmpty():
            break
        clusters = sizes.select(F.col("cluster_id").alias("node"))
        named = connected_components(clusters, hook.select(F.col("cu").alias("src"), F.col("cv").alias("dst")))
        part = materialise(part.join(named.select(F.col("node").alias("cluster_id"), "component"), "cluster_id").select("node", F.col("component").alias("cluster_id")), "merged")
    return part


def until_covered(free: DataFrame, first: DataFrame, enough: float) -> DataFrame:
    """The chosen sets ``free(place, ..)`` up to the one that brings the covered vertices to ``enough``; ``first(node, place)``
    is the first chosen set that holds a vertex."""
    counts = free.select("place").join(first.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "place", "left").na.fill(0, ["n"])
    before = materialise(running_count(counts, "place", "n").select("place", (F.col("upto") - F.col("n")).alias("covered")), "covered-before")
    return before.where((F.col("covered") == 0) | (F.col("covered") < F.lit(enough))).drop("covered").join(free, "place")


def select_seeds(candidates: DataFrame, n_vertices: int, overlap: float = 0.80, coverage: float = 0.15) -> DataFrame:
    """Greedy selection from any sets ``candidates(rank, set_id, node)``: in rank order, a set is skipped if its Jaccard
    overlap with a chosen one exceeds ``overlap``; it ends once ``coverage`` of all vertices are covered.

    Rivals come from a join on the members. In each round the sets that no undecided rival precedes are chosen, and their
    rivals are out. For snapshots ``select_snapshots`` needs no members and no pairs.
    """
    rows = materialise(candidates.select(F.col("rank").alias("place"), "set_id", "node").distinct(), "candidates")
    pairs = jaccard(rows.select(F.col("place").alias("set_id"), "node")).where(F.col("overlap") > overlap).select("a", "b")
    pairs = materialise(pairs, "rivals")
    live, chosen = materialise(rows.select("place").distinct(), "undecided"), []
    while not live.isEmpty():
        waits = pairs.join(live.select(F.col("place").alias("a")), "a", "left_semi").select(F.col("b").alias("place"))
        free = materialise(live.join(waits, "place", "left_anti"), "rivals-chosen")
        chosen.append(free)
        out = pairs.join(free.select(F.col("place").alias("a")), "a", "left_semi").select(F.col("b").alias("place"))
        live = materialise(live.join(free, "place", "left_anti").join(out, "place", "left_anti"), "undecided")
    free = reduce(DataFrame.unionByName, chosen, rows.select("place").limit(0))
    first = rows.join(free, "place", "left_semi").groupBy("node").agg(F.min("place").alias("place"))
    kept = until_covered(materialise(free, "chosen"), materialise(first, "covered"), coverage * n_vertices)
    return rows.join(kept, "place", "left_semi").select(F.col("place").alias("rank"), "set_id", "node")


def heavy_paths(snaps: DataFrame) -> DataFrame:
    """``(node, path)``: snapshots in chains in which each holds more than half of the vertices of the next larger one; the
    chain is named by one of its snapshots' vertices."""
    above = snaps.select(F.col("component").alias("c"), F.col("sid").alias("p"), F.col("node").alias("over"), F.col("nc").alias("size"))
    links = snaps.join(above, (F.col("component") == F.col("c")) & (F.col("parent") == F.col("p"))).where(2 * F.col("nc") > F.col("size"))
    roots = component_roots(links.select(F.col("node").alias("src"), F.col("over").alias("dst")))
    named = roots.select(F.col("node").alias("of"), F.col("root"))
    return snaps.select("node").join(named, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("path"))


#: Undecided sets that one task goes through in their order.
FINISH_SETS = 500_000


def _scan(overlap: float):
    """The sets of all rows (place, path, nc, class) that a scan chooses, with what was chosen by path and class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values("place")
        chosen: dict[tuple[int, int], list[int]] = {}
        taken = []
        for path, nc, at in zip(rows["path"].tolist(), rows["nc"].tolist(), rows["class"].tolist()):
            near = (n for k in (-1, 0, 1) for n in chosen.get((path, at + k), ()))
            free = all(min(n, nc) <= overlap * max(n, nc) for n in near)
            taken.append(free)
            if free:
                chosen.setdefault((path, at), []).append(nc)
        yield rows[taken]

    return run


def independent(candidates: DataFrame, overlap: float) -> DataFrame:
    """The rows of ``candidates(place, path, nc)`` that a scan in the order of ``place`` would choose.

    Two sets of a path are rivals if the smaller has more than ``overlap`` of the larger's vertices, and sets of different paths
    never are (for an overlap of half or more). A set is chosen once no rival that stands before it is undecided, and its
    rivals are out. Sets are put in classes by size, so that rivals are in the same class or in neighbouring ones, and a class
    has at most one chosen set a round: the first of it. A round joins each set with the first ones of three classes. Once
    FINISH_SETS are undecided, one task scans them.
    """
    width = -math.log(max(overlap, 0.5)) + 1e-9
    rows = candidates.withColumn("class", F.floor(F.log("nc") / width))
    live = materialise(rows, "rivals")
    chosen = []
    rival = F.least("nc", "n2") > F.lit(overlap) * F.greatest("nc", "n2")
    near = lambda df: df.select(F.col("path").alias("path2"), F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))).alias("class2"), F.col("place").alias("place2"), F.col("nc").alias("n2"))
    meets = (F.col("path") == F.col("path2")) & (F.col("class") == F.col("class2")) & rival
    while (left := live.count()) > 0:
        if left <= FINISH_SETS:
            rest = live.select("place", "path", "nc", "class").coalesce(1)
            chosen.append(rest.mapInPandas(_scan(overlap), "place bigint, path bigint, nc bigint, class bigint"))
            break
        first = live.groupBy("path", "class").agg(F.min_by("nc", "place").alias("nc"), F.min("place").alias("place")).select("place", "path", "nc", "class")
        # a first one waits if any undecided rival stands before it
        waits = live.join(near(first), meets).where("place < place2").select(F.col("place2").alias("place"))
        free = materialise(first.join(waits, "place", "left_anti"), "rivals-chosen")
        chosen.append(free)
        live = materialise(live.join(near(free), meets, "left_anti"), "rivals")
    return reduce(DataFrame.unionByName, chosen, candidates.limit(0).withColumn("class", F.lit(0).cast("bigint"))).drop("class")


def select_snapshots(
    snaps: DataFrame, value: Column, n_vertices: int, overlap: float = 0.80, coverage: float = 0.15, among: DataFrame | None = None,
    chains: DataFrame | None = None,
) -> DataFrame:
    """``(rank, set_id, node)``: greedy selection, best ``value`` first (ties to the lower component, then the earlier): a
    snapshot is skipped if its Jaccard overlap with a chosen one exceeds ``overlap`` (at least a half); the list ends once
    ``coverage`` of all vertices are covered. ``among``: rows of the snapshots, with any further columns, that take part;
    ``chains``: their ``heavy_paths``, if known.

    Snapshots are nested or apart, and two that share more than half of their vertices lie on one heavy path of the forest, so
    the scan is carried out on all paths at once, in rounds (``independent``). A vertex is covered from the least rank on of the
    chosen snapshots above it, found by pointer doubling; the covered vertices are summed in the order of ranks.
    """
    if overlap < 0.5:
        raise ValueError("overlaps below a half are not found along heavy paths")
    taking = (snaps if among is None else among).withColumn("score", value)
    ranks = placed(taking.select("score", "component", "sid", "node", "nc"), "place", F.desc("score"), F.col("component"), F.col("sid"), first=1)
    ranks = materialise(ranks.join(heavy_paths(snaps) if chains is None else chains, "node").select("place", "path", "nc", "node"), "ranks")
    free = materialise(independent(ranks.select("place", "path", "nc"), overlap).join(ranks.select("place", "node"), "place").select("place", "node"), "chosen")
    marked = snaps.join(free.select(F.col("node").alias("maker"), "place"), F.col("node") == F.col("maker"), "left")
    first = materialise(best_above(marked, -F.col("place")).where("best IS NOT NULL").select("node", (-F.col("best")).alias("place")), "covered")
    kept = until_covered(free, first, coverage * n_vertices)
    picked = kept.join(snaps.select("node", "component", "tin", "tout"), "node")
    members = unrolled(picked, ["place"]).join(snaps.select("component", "tin", "node"), ["component", "tin"])
    return members.select(F.col("place").alias("rank"), F.col("place").alias("set_id"), "node")


def jaccard(sets: DataFrame) -> DataFrame:
    """``(a, b, overlap)`` of the pairs of ``sets(set_id, node)`` that share a vertex, by a join on the member."""
    size = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    other = sets.select(F.col("set_id").alias("b"), "node")
    both = sets.join(other, "node").where("set_id < b").groupBy(F.col("set_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("i"))
    na, nb = size.select(F.col("set_id").alias("a"), F.col("n").alias("na")), size.select(F.col("set_id").alias("b"), F.col("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("overlap"))


def _farthest(picked):
    """Of each batch the point of greatest weight times squared distance to the nearest of ``picked``."""

    def run(batches):
        for b in batches:
            v = np.array(b["vector"].tolist()).reshape(len(b), -1)
            if len(v):
                far = np.min([((v - c) ** 2).sum(1) for c in picked.value], axis=0) * b["w"].to_numpy()
                one = b.assign(far=far).sort_values(["far", "w", "node"], ascending=[False, False, True]).head(1)
                yield one[["far", "w", "node", "vector"]]

    return run


def kmeans(points: DataFrame, k: int, rounds: int = 30, weight: str | None = None) -> DataFrame:
    """``(node, cluster_id)`` of ``points(node, vector[, weight])`` by weighted k-means.

    The first centres are spread out from the heaviest point: each next one is, of all points, that of the
    greatest weight times squared distance to those before (ties to the heavier, then the lower id), one row
    coming back for each. Each round sends k centres to the executors and gets k partial sums back.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = materialise(points.select("node", F.col("vector").cast("array<double>").alias("vector"), w.alias("w")), "kmeans")
    first = rows.orderBy(F.desc("w"), "node").limit(1).toPandas()
    if first.empty:
        return rows.select("node", F.lit(0).cast("bigint").alias("cluster_id"))
    picked = np.array(first["vector"].tolist())
    while len(picked) < k:
        got = rows.mapInPandas(_farthest(rows.sparkSession.sparkContext.broadcast(picked)), "far double, w double, node bigint, vector array<double>")
        got = got.orderBy(F.desc("far"), F.desc("w"), "node").limit(1).toPandas()
        if not got["far"][0] > 0:  # no other points
            break
        picked = np.vstack([picked, got["vector"][0]])
    centres = picked

    def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)).argmin(1)

    for _ in range(rounds):
        at = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches, at=at):
            c = at.value
            total, mass = np.zeros_like(c), np.zeros(len(c))
            for b in batches:
                v, m = np.array(b["vector"].tolist()), b["w"].to_numpy()
                if len(v):
                    near = nearest(v, c)
                    np.add.at(total, near, v * m[:, None])
                    mass += np.bincount(near, m, len(c))
            yield pd.DataFrame({"c": np.arange(len(c)), "mass": mass, "total": total.tolist()})

        parts = rows.mapInPandas(sums, "c int, mass double, total array<double>").select("c", "mass", F.posexplode("total").alias("j", "x"))
        got = parts.groupBy("c", "j").agg(F.sum("x").alias("x"), F.sum("mass").alias("mass")).toPandas()  # k x dimensions
        new = centres.copy()
        c, j = got["c"].to_numpy(), got["j"].to_numpy()
        filled = got["mass"].to_numpy() > 0
        new[c[filled], j[filled]] = (got["x"] / got["mass"].where(got["mass"] > 0, 1))[filled]
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-12:
            break
    at = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            v = np.array(b["vector"].tolist()).reshape(len(b), -1)
            yield pd.DataFrame({"node": b["node"], "cluster_id": nearest(v, at.value) if len(b) else np.zeros(0, int)})

    return rows.mapInPandas(assign, "node bigint, cluster_id bigint")


def stratified_split(labels: DataFrame, per_class: int, n_val: int, n_test: int, seed: int = 42) -> DataFrame:
    """``(node, role)``: the first ``per_class`` of each class in hash order train; of the rest, in hash order,
    ``n_val`` validate, ``n_test`` test and the others have no role."""
    draw = F.md5(F.concat_ws(",", F.lit(seed), "node"))
    train = labels.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(draw, "node"))).where(F.col("k") <= per_class).select("node", F.lit("train").alias("role"))
    rest = labels.join(train.select("node"), "node", "left_anti").orderBy(draw, "node").limit(n_val + n_test)
    k = F.row_number().over(W.orderBy(draw, "node"))
    held = rest.withColumn("k", k).select("node", F.when(F.col("k") <= n_val, "val").otherwise("test").alias("role"))
    roles = train.unionByName(held)
    return labels.select("node").join(roles, "node", "left").select("node", F.coalesce("role", F.lit("none")).alias("role"))
