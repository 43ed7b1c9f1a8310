"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All
but the last return the columns of ``documents``:

* language: documents without a language (no text or no letter) go, all others stay;
* exact: one document stays of each group of equal texts (A-Z lowered), the one of largest id;
* near: one document stays of each class of linked fingerprints, the one of smallest id;
* passages: repeated passages are cut from all but the first document that holds them;
  ``n_chars`` follows the text;
* pack: token pieces in sequences of 2048, along a space-filling curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, lang_id, packing, simhash, substring_dedup
from tidemark.llm.common import stage

_UID, _HASH = "__pipeline_uid", "__pipeline_hash"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language, all columns as they were."""
    model = lang_id.fit(spark, docs.where(~lang_id.held_out()))
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    id_at, text_at = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    made = lang_id.predict(spark, docs.toDF(*names), model, id_at, text_at, [F.col(c) for c in names])
    return made.where(F.col("lang_pred") != lang_id.UNDETERMINED).select(*names).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of largest id; of rows that repeat its id and text, one."""
    made = stage(spark, exact_dedup.exact_dedup(spark, docs), "pipeline-copies")
    key = [F.col("doc_id").alias(_UID), F.col("text_hash").alias(_HASH)]
    rows = made.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*key, "kept")
    chosen = rows.groupBy(_UID, _HASH).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("kept")
    same = docs["doc_id"].eqNullSafe(F.col(_UID)) & (F.xxhash64(docs["text"]) == F.col(_HASH))
    once = docs.join(chosen.where("n = 1").hint("merge"), same, "left_semi")
    # rows that repeat both id and text; one of them has been chosen
    repeated = docs.join(chosen.where("n > 1").hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(repeated)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest id; documents without an id stay.

    Rows go by id and text, as an id may repeat with other texts; if the smallest id itself
    has several texts in the class, the one of least hash stays.
    """
    classes = stage(spark, simhash.simhash_groups(spark, docs, with_text=True), "pipeline-classes")
    key = [F.col("doc_id").alias(_UID), F.col("text_hash").alias(_HASH)]
    later = classes.where(F.col("doc_id") != F.col("component_id")).select(*key)
    lowest = classes.where(F.col("doc_id") == F.col("component_id"))
    tied = lowest.groupBy("class").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most").select("class", "least")
    others = lowest.join(tied.hint("merge"), "class").where("text_hash <> least").select(*key)
    gone = later.union(others).distinct()
    same = (docs["doc_id"] == gone[_UID]) & (F.xxhash64(docs["text"]) == gone[_HASH])
    return docs.join(gone.hint("merge"), same, "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    cut = substring_dedup.substring_dedup(spark, docs).drop("removed_spans")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(spark, docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("pack", pack)]

#: Language ID, fingerprints and tokens are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
