"""Graph, label, cluster and result files in (survey S1-S7). Everything is read by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.functions.ranks import placed
from graphloom.functions.storage import materialise
from graphloom.operators.graph import simple

#: Vertices that are spelled out together.
BLOCK = 100_000


def header_edges(spark: SparkSession, path: str, multigraph: bool = False, first_m: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` of a stream of whitespace-separated integers: ``n m``, then m pairs; ids from 1.

    Lines may break anywhere, between the ends of a pair too; ``path`` may be a folder of parts, read in the order of their names.
    Every block is read by its own task, twice and without a shuffle: once for its number of tokens and its first and last one, once to
    cut pairs out of it, counting on from the blocks before it. Only a pair that breaks between two blocks is put together
    from their ends. Loops and pairs out of range are left out; with ``first_m`` so is what follows the m-th pair, else m is not looked at.
    """
    line = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"),
        F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"),
    ).where(F.size("t") > 0)
    block = line.groupBy("f", "b").agg(
        F.sum(F.size("t")).alias("n"), F.min_by(F.get("t", F.lit(0)), "at").alias("first"), F.max_by(F.element_at("t", -1), "at").alias("last")
    )
    order = W.orderBy("f", "b")  # a row for each block of the files
    block = materialise(block.select("f", "b", (F.sum("n").over(order) - F.col("n")).alias("before"), "first", F.lag("last").over(order).alias("last")), "blocks")
    start = [r["f"] for r in block.where("before < 2").select("f").distinct().collect()]  # of one file, or two
    head = line.where(F.col("f").isin(start)).orderBy("f", "b", "at").select("t").take(2)
    n, m = (int(x) for x in ([x for r in head for x in r["t"]] + ["0", "0"])[:2])
    line = line.join(F.broadcast(block.select("f", "b", "before")), ["f", "b"]).select("before", "t")
    met = block.where("before > 2 AND before % 2 = 1").select(((F.col("before") - 3) / 2).cast("bigint").alias("k"), F.col("last").alias("src"), F.col("first").alias("dst"))
    ends = line.mapInArrow(_cut_pairs, "k bigint, src string, dst string").unionByName(met).where(F.lit(not first_m) | (F.col("k") < m))
    ends = ends.select(*(F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("src", "dst"))).where(F.col("src").between(1, n) & F.col("dst").between(1, n))
    return spark.range(1, n + 1).select(F.col("id").alias("node")), simple(ends, multigraph=multigraph)


def _cut_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(before, t)`` in the order of their blocks as pairs ``(k, src, dst)``, counted from the first after the head.
    ``before``: the tokens of all blocks before a line's own."""
    empty = pa.array([], pa.string())
    block, place, left = None, 0, empty  # of the block: tokens so far, and a first end without its second
    for batch in batches:
        starts = batch.column(0).to_numpy(zero_copy_only=False)
        turns = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)] if len(starts) else [0]
        for lo, hi in zip(turns[:-1], turns[1:]):
            if starts[lo] != block:
                block, place, left = starts[lo], int(starts[lo]), empty
            at = place - len(left)
            t = pa.concat_arrays([left, batch.column(1).slice(lo, hi - lo).flatten().cast(pa.string())])
            place = at + len(t)
            skip = max(0, 2 - at) if at < 2 else at % 2  # the head, or a second end whose first stands in the block before
            t, at = t.slice(skip), at + skip
            whole = len(t) // 2
            left, one = t.slice(2 * whole), 2 * np.arange(whole)
            yield pa.RecordBatch.from_pydict({"k": pa.array((at - 2) // 2 + np.arange(whole), pa.int64()), "src": t.take(pa.array(one)), "dst": t.take(pa.array(one + 1))})


def plain_edges(spark: SparkSession, path: str, multigraph: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)`` of lines of two ids from 0, split by white space or a comma; ``#`` starts a comment.
    The vertices are 0 to the greatest id."""
    t = F.split(F.trim(F.split("value", "#")[0]), r"\s*,\s*|\s+")
    pairs = spark.read.text(path).select(t.alias("t")).select(F.expr("try_cast(t[0] AS bigint)").alias("src"), F.expr("try_cast(get(t, 1) AS bigint)").alias("dst"))
    pairs = pairs.where("src IS NOT NULL AND dst IS NOT NULL")
    top = pairs.agg(F.max(F.greatest("src", "dst")).alias("top"))  # a pass over the file, made only if the vertices are asked for
    some = top.where("top >= 0").select(F.explode(F.sequence(F.lit(0), F.floor(F.col("top") / BLOCK))).alias("k"), "top").repartition("k")
    first = F.col("k") * BLOCK
    vertices = some.select(F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col("top")))).alias("node"))
    return vertices, simple(pairs, multigraph=multigraph)


def dictionary(values: DataFrame, value: str, name: str = "code") -> DataFrame:
    """``(value, code)``: distinct values numbered from 0 in sorted order, nulls left out. Ranges are split between the values
    themselves, so a start that all have in common makes no difference."""
    return placed(values.select(value).where(F.col(value).isNotNull()).distinct(), name, F.col(value))


def citation_graph(spark: SparkSession, content: str | None, cites: str) -> dict[str, DataFrame]:
    """``vertices(node, ext_id, label_id)``, ``edges``, ``features(node, vector)``, ``labels(label_id, name)`` of a
    content file (id, 0/1 features, label) and a citation file (cited, citing). Citations of unknown ids are left
    out; without a content file the ids are those cited or citing, without labels and features."""
    pairs = spark.read.text(cites).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") == 2).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))
    if content:
        rows = spark.read.text(content).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") >= 3)
        rows = rows.select(F.col("t")[0].alias("ext_id"), F.element_at("t", -1).alias("name"), F.slice("t", F.lit(2), F.size("t") - 2).cast("array<float>").alias("vector"))
        labels = dictionary(rows, "name", "label_id")
    else:
        rows = pairs.select(F.explode(F.array("a", "b")).alias("ext_id")).distinct().select("ext_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<float>").alias("vector"))
        labels = dictionary(rows, "name", "label_id")
    ids = dictionary(rows, "ext_id", "node")
    known = rows.join(ids, "ext_id").join(labels, "name", "left")
    a, b = ids.select(F.col("ext_id").alias("a"), F.col("node").alias("src")), ids.select(F.col("ext_id").alias("b"), F.col("node").alias("dst"))
    return {
        "vertices": known.select("node", "ext_id", "label_id"), "edges": simple(pairs.join(a, "a").join(b, "b")),
        "features": known.where("vector IS NOT NULL").select("node", "vector"), "labels": labels.select("label_id", "name"),
    }


CLUSTERS = "meta map<string,string>, clusters array<struct<cluster_id:bigint,component_id:bigint,snapshot_id:bigint,score:double,members:array<bigint>,seed_nodes:array<bigint>>>"


def clusters_json(spark: SparkSession, path: str) -> DataFrame:
    """``(node, cluster_id, score, ordinal)`` of a cluster file; members under ``members`` or ``seed_nodes``.
    A node of several clusters has several rows; ``last_wins`` settles them."""
    doc = spark.read.schema(CLUSTERS).option("multiLine", True).json(path)
    c = doc.select(F.posexplode("clusters").alias("ordinal", "c")).select("ordinal", "c.*")
    return c.select(F.explode(F.coalesce("members", "seed_nodes")).alias("node"), F.coalesce("cluster_id", "ordinal").alias("cluster_id"), "score", F.col("ordinal").cast("bigint").alias("ordinal"))


def results_csv(spark: SparkSession, path: str, parameter: str | None = None) -> DataFrame:
    """CSV files with a header (all text); ``parameter``: a pattern whose first group is read from the file name."""
    df = spark.read.csv(path, header=True)
    return df if parameter is None else df.withColumn("parameter", F.regexp_extract(F.input_file_name(), parameter, 1))
