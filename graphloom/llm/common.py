"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from graphloom.functions.storage import materialise, shared_dir

__all__ = ["extended", "fold", "free_names", "map_arrow", "materialise", "named", "shared_dir", "slices", "table", "total_chars"]


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until no column (of any case) has them."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` on columns of any names: ``run`` finds them by place, as ``c0``, ``c1``, ..."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer text gets a range of its own."""
    lo = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        n = n or 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def extended(fields: list[StructField], **added: str | DataType) -> StructType:
    """A schema of these fields and the added ones."""
    out = StructType(list(fields))
    for name, kind in added.items():
        out = out.add(name, kind)
    return out


def total_chars(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows, and bytes of text."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]
