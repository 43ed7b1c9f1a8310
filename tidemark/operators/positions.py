"""Positions and streams of series too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import dealt


def long_positions(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``pos`` within ``key``, without sorting a key in one task.

    ``bucket`` never falls along the order (such as the day of a timestamp). A row's position is
    the number of rows in lower buckets plus its place in its own; only bucket counts meet.
    """
    marked = rows.withColumn("__bucket", bucket)
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(key, "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1
    placed = marked.withColumn("__place", place).join(offsets, [key, "__bucket"])
    return placed.withColumn("pos", (F.col("__offset") + F.col("__place")).cast("bigint")).drop("__bucket", "__offset", "__place")


def cut_streams(series: DataFrame, points: int) -> DataFrame:
    """Series rows as streams of ``points`` points, each a series with a head of its own: series_id becomes a struct."""
    stream = F.floor(F.col("pos") / points).cast("bigint")
    return dealt(series.select(F.struct("series_id", stream.alias("stream_id")).alias("series_id"), F.pmod("pos", F.lit(points)).cast("bigint").alias("pos"), "v"))


def join_streams(streams: DataFrame, points: int) -> DataFrame:
    """The reverse: positions in the whole series."""
    return streams.select("series_id.series_id", (F.col("series_id.stream_id") * points + F.col("pos")).alias("pos"), "v")
