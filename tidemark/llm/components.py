"""Connected components of a link table, by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected Components in MapReduce
and Beyond" (2014). Minima are aggregated before the shuffle, and the joins back to the
links read written tables, so that Spark can split the links of a hub. Every round is cut
by a table in the shared folder; links are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _large_star(spark: SparkSession, links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-min")
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(spark: SparkSession, links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stage(spark, down.groupBy("u").agg(F.min("v").alias("m")), "small-min")
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two columns of the same orderable type) but the roots.

    The root is the smallest node reachable. Loops and repeated links are allowed. It ends when
    a round changes nothing, after a number of rounds that grows with the logarithm of the links.
    """
    u, v = links.columns
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    links = stage(spark, links, "links")
    seen = None
    while True:
        links = stage(spark, _large_star(spark, links), "large-star")
        links = stage(spark, _small_star(spark, links), "small-star")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
