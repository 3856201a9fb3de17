"""Positions in a total order, counted within ranges so that no task sorts the whole table."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.storage import materialise

#: Rows to a range, beyond which a table is cut into several.
RANGE = 1_000_000


def _ranged(df: DataFrame, value: str, rows: int) -> DataFrame:
    """``df`` with ``__r``: the range of ``value`` that a row falls in, of about ``rows`` rows each (approximate quantiles),
    whether the values are dense, sparse or hashed."""
    n = df.count()
    if n <= rows:
        return df.withColumn("__r", F.lit(0.0))
    parts = -(-n // rows) * 2
    splits = sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts)))
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__v", outputCol="__r")
    return cut.transform(df.withColumn("__v", F.col(value).cast("double"))).drop("__v")


def number(df: DataFrame, by: str, name: str, first: int = 0, width: int = RANGE) -> DataFrame:
    """Adds ``name``: the place of each row in the order of the number column ``by`` (distinct values), from ``first``."""
    rows = _ranged(df, by, width)
    before = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("__r", (F.sum("__n").over(W.orderBy("__r")) - F.col("__n")).alias("__b"))
    inner = F.row_number().over(W.partitionBy("__r").orderBy(by)) - 1 + first
    return rows.withColumn(name, inner).join(before, "__r").withColumn(name, (F.col(name) + F.col("__b")).cast("bigint")).drop("__r", "__b")


def running_count(counts: DataFrame, value: str, count: str, name: str = "upto", rows: int = RANGE) -> DataFrame:
    """Adds ``name`` to a table of distinct numbers and their counts: how many there are up to each, in two steps."""
    ranged = _ranged(counts, value, rows)
    before = ranged.groupBy("__r").agg(F.sum(count).alias("__n"))
    before = before.select("__r", (F.sum("__n").over(W.orderBy("__r")) - F.col("__n")).alias("__b"))
    inner = F.sum(count).over(W.partitionBy("__r").orderBy(value))
    return ranged.withColumn(name, inner).join(before, "__r").withColumn(name, F.col(name) + F.col("__b")).drop("__r", "__b")


def placed(df: DataFrame, name: str, *by: Column, first: int = 0) -> DataFrame:
    """Adds ``name``: the place of each row in the order of the columns ``by``, from ``first``.

    Rows are dealt out by ranges that Spark samples from the columns themselves, so the ranges are even whatever the values:
    numbers, strings with a common start, few distinct first columns. Rows that are equal in all of ``by`` share a task. The
    sorted ranges are written once, so that places hold still; each range's rows are counted and added up.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialise(rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "placed")
    inside = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    # of a range's numbers only the distances count
    before = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min(inside).alias("__0"))
    before = before.select("__p", "__0", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n") + first).alias("__b"))  # a row for each range
    return rows.join(F.broadcast(before), "__p").withColumn(name, (inside - F.col("__0") + F.col("__b")).cast("bigint")).drop("__p", "__i", "__0", "__b")


def running(df: DataFrame, amount: str, name: str, *by: Column) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows up to each in the order of ``by`` (distinct), dealt out as in ``placed``."""
    rows = materialise(df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "running")
    before = rows.groupBy("__p").agg(F.sum(amount).alias("__n"))
    before = before.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each range
    inner = F.sum(amount).over(W.partitionBy("__p").orderBy(*by))
    return rows.withColumn(name, inner).join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__b")
