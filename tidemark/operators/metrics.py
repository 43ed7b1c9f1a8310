"""Sizes, ratios and verification."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bits import effective_bits_column


def raw_bits(series: DataFrame) -> DataFrame:
    """(series_id, file_bits): 64 bits per value."""
    return series.groupBy("series_id").agg((F.count(F.lit(1)) * 64).alias("file_bits"))


def hybrid_ratios(coded: DataFrame) -> DataFrame:
    """(series_id, file_bits, payload_bits, total_bits, payload_ratio, total_ratio) of hybrid containers.

    The payload is methods and residuals; the total also has head, frequencies and count.
    """
    size = lambda c: F.octet_length(c) * 8
    payload = size("method_payload") + size("residual_payload")
    total = payload + 64 * (F.size("head") + F.size("freqs") + 1)
    values = F.size("head") + F.col("n")
    return coded.select(
        "series_id",
        (values * 64).cast("bigint").alias("file_bits"),
        payload.cast("bigint").alias("payload_bits"),
        total.cast("bigint").alias("total_bits"),
        (payload / (values * 64)).alias("payload_ratio"),
        (total / (values * 64)).alias("total_ratio"),
    )


def text_ratios(coded: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """(key, file_bits, ac_bits, ac_ratio) without trailing zero bits on either side."""
    both = coded.select(key, "payload").join(originals.select(key, "text"), key)
    bits = both.select(key, effective_bits_column(F.col("text").cast("binary")).alias("file_bits"), effective_bits_column(F.col("payload")).alias("ac_bits"))
    return bits.withColumn("ac_ratio", F.col("ac_bits") / F.col("file_bits"))


def timed(df: DataFrame, path: str) -> tuple[DataFrame, float]:
    """Writes a table, and returns it read back with the wall seconds that took."""
    began = time.perf_counter()
    df.write.mode("overwrite").parquet(path)
    took = time.perf_counter() - began
    return df.sparkSession.read.schema(df.schema).parquet(path), took


def run_metrics(coded: DataFrame, encoding: float, decoding: float) -> DataFrame:
    """One row of sizes and times of a run over hybrid containers, as the metrics reader takes it."""
    sums = hybrid_ratios(coded).agg(F.sum("file_bits").cast("double").alias("File_bits"), F.sum("payload_bits").cast("double").alias("Compressed_bits"))
    ratio = (F.col("Compressed_bits") / F.col("File_bits")).alias("Compression_ratio")
    return sums.select("File_bits", "Compressed_bits", ratio, F.lit(encoding).alias("Encoding_time"), F.lit(decoding).alias("Decoding_time"))


def verify(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """(n, different, max_abs, mean_abs): one row; missing positions on either side count as different."""
    a = original.select("series_id", "pos", F.col("v").alias("a"))
    b = decoded.select("series_id", "pos", F.col("v").alias("b"))
    both = a.join(b, ["series_id", "pos"], "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("different"),
        F.max(gap).alias("max_abs"),
        F.avg(gap).alias("mean_abs"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated ones included."""
    return not a.exceptAll(b).union(b.exceptAll(a)).limit(1).count()
