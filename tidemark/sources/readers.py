"""Readers of series and texts.

A file's lines keep their order by an explicit position. Files are read in splits, and a line's
position is the count of the lines of earlier splits of its file plus its place in its own, so no
task holds a whole file. JSON arrays and whole texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

INT, FLOAT = 1, 0

PARAMS = StructType(
    [
        StructField("len_series", LongType()),
        StructField("bs", LongType()),
        StructField("timesteps", LongType()),
        StructField("slide", LongType()),
        StructField("sigma", DoubleType()),
        StructField("threshold", DoubleType()),
        StructField("num_values", LongType()),
    ]
)
METRICS = StructType([StructField(c, DoubleType()) for c in ("File_bits", "Compressed_bits", "Compression_ratio", "Encoding_time", "Decoding_time")])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(texts: DataFrame, text_col: str = "text", *keys: str) -> DataFrame:
    """(keys, pos, line) of texts; a line end closes the last line and begins no other."""
    cut = F.split(F.regexp_replace(text_col, "\n$", ""), "\n")
    return texts.where(F.length(text_col) > 0).select(*keys, F.posexplode(cut).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of text files of any size, as ``lines`` of whole texts gives them."""
    here = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")]
    rows = spark.read.text(path).select(*here, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("path", "split").orderBy("at")) - 1
    return rows.withColumn("place", place).join(offsets, ["path", "split"]).select("path", (F.col("offset") + F.col("place")).alias("pos"), "line")


def value_of(text: Column, mode: int = INT) -> Column:
    """The number in a field: an integer, else a float cut to one in integer mode; null if it is neither."""
    number = F.trim(text).try_cast("double")
    return F.coalesce(F.trim(text).try_cast("bigint"), number.try_cast("bigint")) if mode == INT else number


def last_field(line: Column) -> Column:
    return F.element_at(F.split(line, ","), -1)


def first_field(line: Column) -> Column:
    return F.element_at(F.split(F.trim(line), r"\s+"), 1)


def csv_series(spark: SparkSession, path: str, mode: int = INT) -> DataFrame:
    """(path, pos, value) from the last comma field of each line; a field that is no number fails the query."""
    rows = split_lines(spark, path)
    value = value_of(last_field(F.col("line")), mode)
    return rows.select("path", "pos", F.coalesce(value, F.raise_error(F.concat(F.lit("not a number: "), "line")).cast(value_type(mode))).alias("value"))


def value_type(mode: int) -> str:
    return "bigint" if mode == INT else "double"


def txt_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value) from the first field of each line."""
    return split_lines(spark, path).select("path", "pos", first_field(F.col("line")).cast("bigint").alias("value"))


def int_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value) from one integer per line, such as ranks."""
    return split_lines(spark, path).select("path", "pos", F.trim("line").cast("bigint").alias("value"))


def json_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value) from a JSON array per file."""
    return exploded_json(whole_texts(spark, path), "text", "path")


def exploded_json(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    values = F.from_json(text_col, "array<double>")
    return texts.select(*keys, F.posexplode(values).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


def params(spark: SparkSession, path: str) -> DataFrame:
    """Codec parameters from JSON, with a fixed schema."""
    return spark.read.schema(PARAMS).json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)

