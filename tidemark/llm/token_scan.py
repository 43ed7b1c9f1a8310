"""Token counts of flat, unindexed token files by a separator scan.

Method: a token file is a run of fixed-width ids in which an end-of-document id closes each
document; there is no index. The files are read by byte ranges of a fixed number of ids, cut
without regard to documents. Each block is searched for the separator in one vectorised
comparison. A prefix scan over the blocks of a file (running token and separator counts, and
the running maximum of the last separator seen) then gives each block the position where its
first document began, which stitches documents that cross blocks.

Files: ids are little-endian, of 2 bytes where the vocabulary fits in them and of 4 bytes
else. Built files hold ids and separators and nothing else; which documents a file holds, in
order, is told by a table of names beside them, which knows no position and no length. A
file is written and read by Arrow in the folder that the cluster shares; its name holds the
attempt of its task, and only files of attempts whose names were committed are read, so a
lost executor leaves at most a stray file.

Distribution: blocks are independent and no task holds more than one; the scan over a file
handles one row of totals per block, which is joined back to the separators of the block.

Edge cases: a document may be empty, or span any number of blocks; ids after the last
separator form a document with ``closed`` false; an empty file has no documents, and bytes
after the last whole id are ignored; null text counts as empty when files are built; special
token strings in a text are plain text then, so that the separator only closes documents;
null, repeated or clashing columns of the source table pass or are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import ship, stage, text_bytes, work_dir

BLOCK = 1 << 18
SEPARATOR = 50256
_NAMES = "file string, first long, doc_ids array<long>"


def width_of(path: str) -> int:
    """Bytes of an id of this vocabulary in a file."""
    return 2 if max(bpe.load(path).token_bytes) < 1 << 16 else 4


def _file_batches(batches: Iterable[pa.RecordBatch], path: str, folder: str, separator: int, width: int) -> Iterator[pa.RecordBatch]:
    """Documents to one flat file per task; the rows name its documents in order."""
    task = TaskContext.get()
    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
    coder, kind = bpe.load(path), f"<u{width}"
    end = np.array([separator], kind).tobytes()
    out, first = None, 0
    for b in bpe.in_parts(batches):
        if out is None:
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(f"{root}/{name}")
        for raw in b.column(1).to_pylist():
            ids = coder.encode(bpe.as_text(raw), special=False)
            out.write((ids if width == 4 else np.frombuffer(ids, "<u4").astype(kind).tobytes()) + end)
        listed = pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), listed], names=["file", "first", "doc_ids"])
        first += b.num_rows
    if out is not None:
        out.close()


def build_token_files(
    spark: SparkSession, docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[str, DataFrame]:
    """Writes flat files; returns their folder, and the names (file, first, doc_ids): the documents from number ``first`` on, in order."""
    ship(spark)
    path = path or bpe.vocabulary_path(bpe.VOCABULARY)
    folder, width = f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}", width_of(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return folder, stage(spark, rows.mapInArrow(lambda it: _file_batches(it, path, folder, separator, width), _NAMES), "token-names")


def token_file_blocks(spark: SparkSession, folder: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Byte ranges (file, path, block, start, length) of the flat files in a folder, from its listing alone."""
    files = spark.read.format("binaryFile").load(folder).select("path", (F.col("length") - F.col("length") % width).alias("bytes")).where("bytes > 0")
    size = block * width
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / size)))
    start = F.col("block") * size
    blocks = files.select("path", "bytes", numbers.alias("block")).withColumn("length", F.least(F.lit(size).cast("long"), F.col("bytes") - start))
    return blocks.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "block", start.alias("start"), "length")


def _separator_batches(batches: Iterable[pa.RecordBatch], separator: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, path, block, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
            store, name = pyarrow.fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                ids = np.frombuffer(f.read_at(length, start), f"<u{width}")
            found = np.flatnonzero(ids == separator)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["file", "block", "n", "seps"]
            )


def count_tokens(spark: SparkSession, blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """One row per document of the files: file, ordinal, start, n_tokens (without the separator), closed."""
    ship(spark)
    dealt = blocks.select("file", "path", "block", "start", "length").repartition("file", "block")
    found = stage(spark, dealt.mapInArrow(lambda it: _separator_batches(it, separator, width), "file string, block long, n long, seps array<long>"), "separators")
    totals = found.select("file", "block", "n", F.size("seps").alias("k"), F.when(F.size("seps") > 0, F.element_at("seps", -1)).alias("last"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    based = (
        totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(order).isNull())
    )
    # the position after the last separator of earlier blocks, where this block's first document began
    open_start = F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0))
    stitched = based.withColumn("open", open_start).select("file", "block", "base", "ordinal", "is_last", "open", F.coalesce(F.col("base") + F.col("last") + 1, "open").alias("rest"))
    whole = found.join(stitched, ["file", "block"])
    ends = F.when(F.col("is_last") & (F.col("rest") < F.col("base") + F.col("n")), F.concat("seps", F.array("n"))).otherwise(F.col("seps"))
    rows = whole.withColumn("ends", ends).select("*", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("open")).otherwise(F.col("base") + F.expr("ends[at - 1]") + 1)
    return rows.select(
        "file",
        (F.col("ordinal") + F.col("at")).alias("ordinal"),
        start.alias("start"),
        (F.col("base") + F.col("end") - start).alias("n_tokens"),
        (F.col("at") < F.size("seps")).alias("closed"),
    )


def document_token_counts(
    spark: SparkSession, docs: DataFrame, path: str | None = None, block: int = BLOCK, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Builds flat files from documents, scans them, and names each scanned document: doc_id, n_tokens, file, ordinal, start."""
    path = path or bpe.vocabulary_path(bpe.VOCABULARY)
    width = width_of(path)
    folder, names = build_token_files(spark, docs, path, separator, id_col, text_col)
    if names.isEmpty():  # no file, and so no folder
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, ordinal long, start long")
    committed = names.select("file").distinct()
    counted = count_tokens(spark, token_file_blocks(spark, folder, block, width).join(committed, "file", "left_semi"), separator, width)
    listed = names.select("file", F.posexplode("doc_ids").alias("at", "doc_id"), "first")
    listed = listed.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return counted.join(listed, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
