"""Graphs as relations: ``edges(src, dst)`` in canonical order (src < dst), ``vertices(node)``.

Defined results: functions here take edges as they stand (``simple`` cleans them): a repeated edge counts as often as it stands, a
loop at both of its ends, a null end never joins. A repeated vertex has its row each time, a null one has degree 0. Edges of
vertices outside the table count for those inside. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions.storage import materialise
from graphloom.operators.components import connected_components

#: Facts to a task where pairs are made of them, and the fewest worth one.
TASK_FACTS, LEAST_FACTS = 250_000, 20_000
#: Edges to a task where repeated ones are merged.
TASK_EDGES = 2_000_000


def simple(edges: DataFrame, src: str = "src", dst: str = "dst", multigraph: bool = False, rows: int | None = None) -> DataFrame:
    """Canonical end order, no loops; duplicate edges merged unless ``multigraph``. A task's table of edges grows with its share of
    them: with ``rows``, their number, they are dealt out over as many tasks as they fill."""
    e = edges.where(F.col(src) != F.col(dst)).select(
        F.least(src, dst).cast("bigint").alias("src"), F.greatest(src, dst).cast("bigint").alias("dst")
    )
    if multigraph:
        return e
    return (e if rows is None else e.repartition(max(1, -(-rows // TASK_EDGES)), "src", "dst")).distinct()


def proper(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different vertices that are not null, and the edges between two of them; loops are left out, repeated edges stay."""
    own = vertices.select(F.col("node").cast("bigint").alias("node")).where(F.col("node").isNotNull()).distinct()
    ends = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src <> dst")
    return own, induced(ends, own)


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge. Unrolled in place, so the edges are read once."""
    both = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d")))
    return edges.select(F.inline(both))


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, deg)``, 0 for isolated vertices."""
    count = symmetrise(edges).groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return vertices.select("node").join(count, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg"))


def out_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which the node is the smaller end only."""
    count = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    return vertices.select("node").join(count, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg"))


def neighbour_degree_sum(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, nbr_deg)``: the degrees of a node's neighbours added up. Degrees are written first: by their size Spark then sends
    them to the edges, as long as they are few, and sorts the edges by vertex only beyond."""
    d = materialise(degree(vertices, edges).withColumnRenamed("node", "d"), "degrees")
    total = symmetrise(edges).join(d, "d").groupBy(F.col("s").alias("node")).agg(F.sum("deg").alias("nbr_deg"))
    return vertices.select("node").join(total, "node", "left").select("node", F.coalesce("nbr_deg", F.lit(0)).cast("bigint").alias("nbr_deg"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges with both ends in ``members(node)``."""
    m = members.select("node").distinct()
    return edges.join(m, edges["src"] == m["node"], "left_semi").join(m, edges["dst"] == m["node"], "left_semi")


def within(edges: DataFrame, low: int, high: int) -> DataFrame:
    return edges.where(F.col("src").between(low, high) & F.col("dst").between(low, high))


def neighbours(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The neighbours of a set that lie inside and outside of it."""
    m = members.select("node").distinct()
    near = symmetrise(edges).join(m, F.col("s") == m["node"], "left_semi").select(F.col("d").alias("node")).distinct()
    return near.join(m, "node", "left_semi"), near.join(m, "node", "left_anti")


def set_statistics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: size, edges, least, mean and greatest internal degree, density, whether connected."""
    m = members.select("node").distinct()
    inner = induced(edges, m)
    d = degree(m, inner)
    parts = connected_components(m, inner).agg(F.countDistinct("component").alias("parts"))
    stats = d.agg(
        F.count(F.lit(1)).alias("size"), (F.sum("deg") / 2).cast("bigint").alias("n_edges"), F.min("deg").alias("min_deg"),
        F.avg("deg").alias("avg_deg"), F.max("deg").alias("max_deg"),
    )
    density = F.when(F.col("size") > 1, F.col("n_edges") * 2.0 / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    return stats.crossJoin(F.broadcast(parts)).select("*", density.alias("density"), (F.col("parts") == 1).alias("connected")).drop("parts")


def project_pairs(facts: DataFrame, item: str, group: str) -> DataFrame:
    """Weighted graph of the items that share groups: ``(src, dst, weight)`` with the number of shared groups.

    Few pairs repeat within a task, so a task's table of counts is as large as its pairs: facts, and then pairs, are dealt out over as
    many tasks as the facts fill, and a task's memory stays where it is as they grow.
    """
    rows = facts.count()
    tasks = max(1, -(-rows // TASK_FACTS), min(facts.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_FACTS)))
    f = facts.select(F.col(group).alias("g"), F.col(item).cast("bigint").alias("i")).repartition(tasks, "g").distinct()
    a, b = f.select("g", F.col("i").alias("src")), f.select("g", F.col("i").alias("dst"))
    pairs = a.join(b, "g").where("src < dst").select("src", "dst").repartition(2 * tasks, "src", "dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def heaviest(pairs: DataFrame, share: float = 0.9) -> DataFrame:
    """The pairs whose weight reaches the discrete ``share`` percentile of all weights."""
    cut = pairs.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY weight)").alias("cut"))
    return pairs.crossJoin(F.broadcast(cut)).where("weight >= cut").select("src", "dst", "weight")
