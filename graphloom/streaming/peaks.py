"""Best snapshot of each component over a stream of snapshots (survey G12, section 2.12).

State is one number triple for each component. The update is a maximum, so the order of arrival does not
matter, late rows need no watermark, and a restarted query continues from its checkpoint.

Defined results: rows with a null component form one of their own; rows with a null size or energy, and snapshots of one vertex,
count for nothing; a repeated row changes nothing. An empty stream gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "component bigint, sid bigint, nc bigint, score double"
#: Keyed state with several values and timers needs this store of Spark's.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def scored(stream: DataFrame, eps: float) -> DataFrame:
    s = stream.where("nc > 1").select("component", "sid", "nc", (F.col("nc") / (F.col("q") + eps)).alias("score"))
    return s.where("score IS NOT NULL AND sid IS NOT NULL")


def track_peaks(stream: DataFrame, eps: float) -> DataFrame:
    """Update-mode stream of ``(component, sid, nc, score)`` by a built-in aggregation."""
    s = scored(stream, eps)
    top = s.groupBy("component").agg(F.max(F.struct("score", "nc", (-F.col("sid")).alias("neg"))).alias("m"))
    return top.select("component", (-F.col("m.neg")).alias("sid"), F.col("m.nc").alias("nc"), F.col("m.score").alias("score"))


class Peak(StatefulProcessor):
    """A component's best snapshot so far; a row goes out only when it improves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "score double, nc bigint, neg bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.best.get()) if self.best.exists() else None
        best = old
        for b in rows:
            for score, nc, sid in zip(b["score"], b["nc"], b["sid"]):
                new = (float(score), int(nc), -int(sid))
                best = new if best is None or new > best else best
        if best != old:
            self.best.update(best)
            yield pd.DataFrame({"component": [key[0]], "sid": [-best[2]], "nc": [best[1]], "score": [best[0]]}).astype({"component": "Int64"})

    def close(self) -> None:
        pass


def track_peaks_stateful(stream: DataFrame, eps: float) -> DataFrame:
    """The same with explicit keyed state. The session's state store must be STORE (``follow`` sees to it)."""
    return scored(stream, eps).groupBy("component").transformWithStateInPandas(Peak(), SCHEMA, "update", "none")


def follow(stream: DataFrame, eps: float, path: str, checkpoint: str, once: bool = True):
    """Starts the stateful query; ``path`` gets the rows that changed, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so a restart from ``checkpoint`` neither loses nor
    doubles a row. ``once``: ends when all that is there has been read. Returns the started query.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        out = track_peaks_stateful(stream, eps).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out).start()
    finally:  # a query keeps the settings that it was started with
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """``(component, sid, nc, score)``: of each component the row of the last batch that changed it."""
    rows = spark.read.schema(f"{SCHEMA}, batch bigint").parquet(path)
    return rows.groupBy("component").agg(F.max_by(F.struct("sid", "nc", "score"), "batch").alias("m")).select("component", "m.*")
