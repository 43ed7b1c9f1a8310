"""Writers of series, ranks, codec tables, parameters and metrics.

Folders follow dataset/model/window_step_batch by ``partitionBy``. Text output is one line per
value in the order of the series; a series is written by one task, different ones by many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = ("dataset", "model", "win", "pred", "batch")


def formatted(value: Column, decimals: int | None) -> Column:
    """``%d`` for integers, else ``%.{decimals}f``."""
    return F.format_string("%d", value) if decimals is None else F.format_string(f"%.{decimals}f", value)


def series_lines(df: DataFrame, path: str, keys: list[str], decimals: int | None = None, value: str = "value") -> None:
    """One value per line, a folder per series."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, "pos")
    ordered.select(*keys, formatted(F.col(value), decimals).alias("line")).write.mode("overwrite").partitionBy(*keys).text(path)


def series_row(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, line): the values of a series as ``%.0f``, separated by spaces."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: F.format_string("%.0f", x[value].cast("double")))
    return df.groupBy(*keys).agg(F.concat_ws(" ", values).alias("line"))


def json_row(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, json): the values of a series as a JSON array."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value])
    return df.groupBy(*keys).agg(F.to_json(values).alias("json"))


def method_residuals_csv(rows: DataFrame, path: str) -> None:
    """Header ``method,residual``, one row per coded point."""
    rows.select("method", "residual").write.mode("overwrite").csv(path, header=True)


def partitioned(df: DataFrame, path: str) -> None:
    """Parquet under dataset/model/window/step/batch."""
    df.write.mode("overwrite").partitionBy(*LAYOUT).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Parameters or metrics, one JSON object per row."""
    df.write.mode("overwrite").json(path)
