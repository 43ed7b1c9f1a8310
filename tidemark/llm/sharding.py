"""Proportional stratified interleaving: shards that all carry the corpus mixture.

Method: rows are shuffled by a seeded hash of id, text CRC and size and ranked within their
source; the fractional rank (rank + phase) / rows-of-the-source orders all rows, so that every
run of that order holds each source in proportion; the order is cut into equal runs. Law:
``rows`` (shard counts differ by one at most).

Distribution: no source and no global order is ever sorted in one task. Rows that agree in
all that is ranked (source, id, CRC, size) are counted first and take consecutive ranks, so a
copied row, or a null id, is no hot key. Ranks come from about sqrt(N) hash buckets: a
row's rank is the count of the rows in lower buckets plus its place in its own bucket. The
second order is cut into buckets by the fractional rank itself, which is spread evenly by
construction. Only bucket counts (about sqrt(N) rows) meet in one task. Texts are read once
and not shuffled; everything is DataFrame code.

Edge cases: null text has size 1 and CRC 0; a null source is a source of its own; null ids
rank first and are spread by CRC and size; equal rows are interchangeable; equal texts of
other ids are not kept together, which no law of equal counts could do; fewer rows than
shards leave shards empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, text_bytes

SEED = "interleave-1"


def _fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 in hex."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def interleave_shards(
    spark: SparkSession,
    docs: DataFrame,
    n_shards: int = 8,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), stratum."""
    text = text_bytes(text_col)
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), stratum.alias("stratum"))
    rows = stage(spark, rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, math.isqrt(total))
    tie = ("doc_id", "text_crc32", "size")

    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    keyed = rows.withColumn("h", F.md5(named)).withColumn("b", F.floor(_fraction(F.col("h")) * buckets))
    in_source = Window.partitionBy("stratum", "b").orderBy("h", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("at", F.sum("n").over(in_source) - F.col("n"))
    per_source = Window.partitionBy("stratum")
    counts = (
        keyed.groupBy("stratum", "b")
        .agg(F.sum("n").alias("of_bucket"))
        .select(
            "stratum",
            "b",
            (F.sum("of_bucket").over(per_source.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("of_bucket")).alias("before"),
            F.sum("of_bucket").over(per_source).alias("of_source"),
        )
    )
    phase = _fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum"))))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    ranked = placed.join(counts, ["stratum", "b"]).select("doc_id", "size", "text_crc32", "stratum", "before", "at", "of_source", each)
    rank = F.col("before") + F.col("at") + F.col("copy")
    ranked = ranked.select("doc_id", "size", "text_crc32", "stratum", ((rank + phase) / F.col("of_source")).alias("f"))
    ranked = stage(spark, ranked.withColumn("b", F.floor(F.col("f") * buckets)), "shard-ranks")

    # about sqrt(N) counts, the only rows that meet in one task
    before = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = ranked.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", before.alias("before"))
    in_bucket = Window.partitionBy("b").orderBy("f", "stratum", *tie)
    ordered = ranked.withColumn("at", F.row_number().over(in_bucket) - 1).join(offsets, "b").withColumn("pos", F.col("before") + F.col("at"))
    shard = F.floor(F.col("pos") * n_shards / F.lit(max(total, 1)))
    exact = F.expr(f"(pos * {n_shards}L) div {max(total, 1)}L") if total < 2**59 else shard
    start = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        ordered.withColumn("shard", exact.cast("int"))
        .withColumn("slot", (F.col("pos") - start).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum")
    )
