"""Where intermediate tables go.

Executors share only the folder named by ``spark.checkpoint.dir``; anything that must outlive an
executor is written there as Parquet and read back, which also cuts the lineage. Steps stay until the cluster clears the folder,
or until the end of a ``scratch`` block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in this one process (local tests).
LOCAL_FALLBACK = "file:///tmp/checkpoints/graphloom"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode, where none need be set, a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if not active:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        active = LOCAL_FALLBACK
    return active.rstrip("/")


#: The steps written in each open ``scratch`` block.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, what ``materialise`` has written within. The results must have been written
    or collected by then: DataFrames made in the block read its steps."""
    _OPEN.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)


def materialise(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
