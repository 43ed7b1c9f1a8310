"""Tables as series rows (series_id, pos, v): an explicit position, and values as scaled integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import scaled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str = "series_id") -> DataFrame:
    """Rows by series over all shuffle partitions.

    What follows works by series in one exchange. Its cost is the work per point rather than
    bytes, so the partitions are not merged by their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def series(df: DataFrame, key: str, value: str, order: list[str], decimals: int = 2) -> DataFrame:
    """One row per value that is not null; positions follow the given total order."""
    rows = dealt(df.where(F.col(value).isNotNull()).select(F.col(key).alias("series_id"), *order, F.col(value).alias("value")))
    pos = F.row_number().over(Window.partitionBy("series_id").orderBy(*order)) - 1
    return rows.select("series_id", pos.cast("bigint").alias("pos"), scaled(F.col("value"), decimals).alias("v"), "value")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"])
