"""Residuals of an unbounded stream of points: the last two values of each series are the state.

The reading order of a series is the order of arrival; within a batch, that of ``pos``. State
holds two values and a count per series. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.shipping import new_path, ship

OUTPUT = "series_id bigint, pos bigint, v bigint, naive bigint, linear bigint"


class Residuals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(c, LongType()) for c in ("last", "before", "n")]
        self.state = handle.getValueState("tail", StructType(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("pos")
        last, before, n = self.state.get() if self.state.exists() else (0, 0, 0)
        naive: list[int | None] = []
        linear: list[int | None] = []
        for v in data["v"].tolist():
            naive.append(v - last if n >= 1 else None)
            linear.append(v - (2 * last - before) if n >= 2 else None)
            last, before, n = int(v), last, n + 1
        self.state.update((last, before, n))
        yield pd.DataFrame(
            {"series_id": key[0], "pos": data["pos"].to_numpy(), "v": data["v"].to_numpy(), "naive": pd.array(naive, "Int64"), "linear": pd.array(linear, "Int64")}
        )

    def close(self) -> None:
        pass


def stream_residuals(points: DataFrame) -> DataFrame:
    """Residuals of streaming rows (series_id bigint, pos bigint, v bigint). Needs the RocksDB state store."""
    ship(points.sparkSession)
    return points.groupBy("series_id").transformWithStateInPandas(statefulProcessor=Residuals(), outputStructType=OUTPUT, outputMode="append", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(spark: SparkSession, points: DataFrame) -> DataFrame:
    """Runs over all that is there now and returns the residuals as a table.

    Output and checkpoint lie in the shared folder.
    """
    base = new_path(spark, "stream")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        made = stream_residuals(points).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        made.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUTPUT).parquet(f"{base}/out")
