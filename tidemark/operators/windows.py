"""Strided context and target windows over series rows (series_id, pos, v), and stream layouts.

L is the context, S the step: window w covers positions [w*S, w*S + L + S); the last S are its
targets. A series of n values has ceil((n - L)/S) windows; the last may reach past the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_window(length: int, step: int) -> None:
    if length < 1 or step < 1 or length % step:
        raise ValueError("the context must be a positive multiple of the step")


def layout(series: DataFrame, length: int, step: int) -> DataFrame:
    """(series_id, n, windows, rem): size, number of windows and padding of each series."""
    n = F.count(F.lit(1))
    windows = F.greatest(F.lit(0), F.ceil((n - length) / step)).cast("bigint")
    sizes = series.groupBy("series_id").agg(n.alias("n"), windows.alias("windows"))
    rem = F.when(F.col("windows") > 0, F.col("windows") * step - (F.col("n") - length)).otherwise(0)
    return sizes.withColumn("rem", rem.cast("bigint"))


def padded(series: DataFrame, length: int, step: int, fill: int = 0) -> DataFrame:
    """The series with whole windows: ``rem`` further rows of the fill value."""
    ends = layout(series, length, step).where("rem > 0")
    more = ends.select("series_id", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("rem") - 1)).alias("pos"), F.lit(fill).cast(series.schema["v"].dataType).alias("v"))
    return series.select("series_id", "pos", "v").unionByName(more)


def strided(series: DataFrame, length: int, step: int) -> DataFrame:
    """(series_id, win, ctx, tgt) over a padded series: slices of one array per series, which a long series is cut for first."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    rows = series.groupBy("series_id").agg(whole.alias("w")).where(F.size("w") >= length + step)
    last = F.floor((F.size("w") - length) / step).cast("bigint") - 1

    def cut(k: Column) -> Column:
        at = (k * step + 1).cast("int")
        return F.struct(k.alias("win"), F.slice("w", at, F.lit(length)).alias("ctx"), F.slice("w", at + length, F.lit(step)).alias("tgt"))

    return rows.select("series_id", F.inline(F.transform(F.sequence(F.lit(0).cast("bigint"), last), cut)))


def streams(n_windows: Column, batch: int) -> dict[str, Column]:
    """How windows are dealt to ``batch`` streams: size of a stream, streams before the final one, windows of the final one."""
    per = F.floor(n_windows / batch).cast("bigint")
    uneven = n_windows % batch > 0
    if batch == 1:
        return {"per_stream": n_windows, "streams": F.lit(0).cast("bigint"), "final_windows": n_windows}
    return {
        "per_stream": per,
        "streams": F.when(uneven, F.lit(batch)).otherwise(batch - 1).cast("bigint"),
        "final_windows": F.when(uneven, n_windows % batch).otherwise(per).cast("bigint"),
    }


def stream_layout(sizes: DataFrame, length: int, step: int, batch: int) -> DataFrame:
    """(series_id, stream_id, is_final, first_window, windows, coded_windows) of layout rows.

    A stream that is not final begins with its own raw head, which stands for its last
    length/step windows, and codes the rest.
    """
    laid = sizes.where("windows > 0").select("series_id", *[c.alias(k) for k, c in streams(F.col("windows"), batch).items()])
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("streams"))).alias("stream_id")
    rows = laid.select("*", ids).withColumn("is_final", F.col("stream_id") == F.col("streams"))
    own = F.when(F.col("is_final"), F.col("final_windows")).otherwise(F.col("per_stream"))
    coded = F.when(F.col("is_final"), own).otherwise(F.greatest(F.lit(0), own - length // step))
    return rows.where(own > 0).select(
        "series_id", "stream_id", "is_final", (F.col("stream_id") * F.col("per_stream")).alias("first_window"), own.alias("windows"), coded.alias("coded_windows")
    )


def stripped(series: DataFrame, sizes: DataFrame) -> DataFrame:
    """The series without its padding: positions below ``n`` of the layout."""
    return series.join(sizes.select("series_id", "n"), "series_id").where(F.col("pos") < F.col("n")).drop("n")
