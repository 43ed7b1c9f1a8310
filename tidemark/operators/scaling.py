"""Quantile scalers per series, from exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantile_scaler(series: DataFrame, alpha: float = 0.95, beta: float = 0.3, basic: bool = False, value: str = "value") -> DataFrame:
    """(series_id, shift, q). NaN is left out.

    Basic: q is the alpha quantile of the sizes, at least 0.01, and nothing is shifted.
    Else the shift lies beta spans below the minimum and q is the alpha quantile above it;
    a q of 0 is 1.
    """
    x = F.col(value).cast("double")
    rows = series.where(~F.isnan(x))
    if basic:
        return rows.groupBy("series_id").agg(F.lit(0.0).alias("shift"), F.greatest(F.percentile(F.abs(x), F.lit(alpha)), F.lit(0.01)).alias("q"))
    # the quantile moves with a shift, so one pass is enough
    made = rows.groupBy("series_id").agg((F.min(x) - beta * (F.max(x) - F.min(x))).alias("shift"), F.percentile(x, F.lit(alpha)).alias("p"))
    q = F.col("p") - F.col("shift")
    return made.select("series_id", "shift", F.when(q == 0, 1.0).otherwise(q).alias("q"))
