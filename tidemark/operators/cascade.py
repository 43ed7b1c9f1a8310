"""The three-sigma cascade over series of scaled integers (series_id, pos, v).

Sigma is the population deviation of the value against the one before it over the coded
points (pos >= head); the threshold is three sigma. The first method whose error is within it
wins, in the order last value, line, model; if none is, the smallest error wins, ties to the
earlier method. One exchange and one sort by series serve the lags and sigma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.predictors import linear, naive, window_mean

SIMPLE, LINEAR, MODEL = 0, 1, 2


def sigma_of(residual: Column) -> Column:
    return F.coalesce(F.stddev_pop(residual), F.lit(1.0))


def series_sigma(series: DataFrame, head: int) -> DataFrame:
    """(series_id, sigma, threshold); 1 where there is no coded point."""
    errors = series.select("series_id", "pos", (F.col("v") - naive()).alias("e"))
    coded = F.when(F.col("pos") >= head, F.col("e"))
    return errors.groupBy("series_id").agg(sigma_of(coded).alias("sigma")).withColumn("threshold", 3 * F.col("sigma"))


def choose(errors: list[Column], threshold: Column) -> Column:
    """The number of the method; a null error is no candidate."""
    within = F.lit(None).cast("int")
    for k, e in reversed(list(enumerate(errors))):
        within = F.when(e <= threshold, F.lit(k)).otherwise(within)
    least = F.least(*errors) if len(errors) > 1 else errors[0]
    smallest = F.lit(None).cast("int")
    for k, e in reversed(list(enumerate(errors))):
        smallest = F.when(e == least, F.lit(k)).otherwise(smallest)
    return F.coalesce(within, smallest).cast("int")


def hybrid_rows(series: DataFrame, head: int, tiers: int = 2, mean_length: int = 16, forecasts: DataFrame | None = None) -> DataFrame:
    """(series_id, pos, v, method, residual) of the coded points.

    The third tier is the window mean, or a plug-in's ``forecasts`` (``predictors.model_forecasts``); a
    point without a forecast leaves it out.
    """
    if forecasts is not None:
        series, tiers = series.select("series_id", "pos", "v").join(forecasts, ["series_id", "pos"], "left"), 3
    predictions = [naive(), linear(), window_mean(mean_length) if forecasts is None else F.col("forecast")][:tiers]
    names = [f"p{k}" for k in range(tiers)]
    rows = series.select("series_id", "pos", "v", *[p.alias(n) for p, n in zip(predictions, names, strict=True)]).where(F.col("pos") >= head)
    sigma = sigma_of_window(F.col("v") - F.col("p0"))
    rows = rows.withColumn("threshold", 3 * sigma)
    method = choose([F.abs(F.col("v") - F.col(n)) for n in names], F.col("threshold"))
    rows = rows.withColumn("method", method)
    chosen = F.lit(None).cast("bigint")
    for k, n in reversed(list(enumerate(names))):
        chosen = F.when(F.col("method") == k, F.col(n)).otherwise(chosen)
    return rows.select("series_id", "pos", "v", "method", (F.col("v") - chosen).alias("residual"))


def sigma_of_window(residual: Column) -> Column:
    return F.coalesce(F.stddev_pop(residual).over(Window.partitionBy("series_id")), F.lit(1.0))


def method_counts(rows: DataFrame) -> DataFrame:
    """(method, n_rows, n_series)."""
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("series_id").alias("n_series"))


def prefix_decode(residuals: DataFrame) -> DataFrame:
    """(series_id, pos, v) from last-value residuals, the first being the value itself: a prefix sum."""
    order = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return residuals.select("series_id", "pos", F.sum("residual").over(order).alias("v"))
