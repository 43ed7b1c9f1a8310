"""Packing along a space-filling curve.

Method: a document's token ids are hashed into a signed vector of DIMS_HASHED counters,
scaled to length one, projected to DIMS dimensions by a seeded Gaussian matrix, and placed on
a grid by the logistic approximation of the normal distribution. The Hilbert key of the grid
cell orders the documents, so that neighbours in the order have similar words. The ordered
token stream is cut every ``length`` ids, so that only the last sequence holds padding.

Distribution: the ids are written once. Only keys and lengths are range-sorted; running
totals inside each range plus the totals of the ranges before it (one row per range) give
every document its place in the stream, which is joined back to its ids.

Edge cases: null text counts as empty and packs as its end id alone; documents longer than a
sequence are cut into pieces; equal keys are ordered by id and then by row; null and repeated
ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import Memo, as_text, byte_alphabet, in_parts, vocabulary_path
from tidemark.llm.common import ship, stage, text_bytes

VOCABULARY, END_ID, LENGTH = "word_bpe_49k.json", 1, 2048
DIMS_HASHED, DIMS, BITS, SEED, MEMO = 256, 4, 12, 20177, 300_000
#: Marks that end a chunk without being part of a word; after the last letter they are one token of the pattern.
MARKS_TEXT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARKS = MARKS_TEXT.encode()


class WordTokens:
    """Ids by the tokenizers library's model; what recurs is kept in tables of a fixed size.

    The vocabulary's normalizer and pre-tokenizer treat white space as nothing but a
    boundary, so the ids of a text are those of its white-space-separated chunks in order.
    Chunks of characters below U+0250 are lowered and cut here, where lower case, letters and
    digits are the same in all Unicode versions; others pass the library's own normalizer
    and pre-tokenizer.
    """

    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed by the vocabulary file

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.letter, self.kind = ("H", "<u2") if self.size <= 1 << 16 else ("I", "<u4")
        self.cut = regex.compile(self.CUT).findall
        self.plain = regex.compile("[\x00-\u024f]*").fullmatch
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.packers = [struct.Struct(f"<{n}{self.letter}").pack for n in range(64)]
        self.chunks = Memo(MEMO, self._chunk)
        self.words = Memo(MEMO, self._word)

    def _word(self, word: str) -> bytes:
        """A pre-token in lower case."""
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.stand_in.__getitem__, word.encode("utf-8")))
        ids = [t.id for t in self.model.tokenize(word)]
        return self.packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        # the usual chunks: letters, with or without marks after them
        if chunk.isalpha():  # of bytes: ASCII letters only
            return self.words[chunk.decode().lower()]
        body = chunk.rstrip(MARKS)
        if body.isalpha():
            return self.words[body.decode().lower()] + self.words[chunk[len(body) :].decode()]
        text = as_text(chunk)
        if self.plain(text):
            low = text.lower()
            bare = low.rstrip(MARKS_TEXT)
            if bare.isalpha():
                return self.words[bare] + self.words[low[len(bare) :]] if len(bare) < len(low) else self.words[low]
            if "<|" not in text:
                return b"".join([self.words[w] for w in self.cut(low)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids without the end id, as little-endian unsigned integers of type ``kind``."""
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=2)
def _projection(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    ids = np.arange(size, dtype=np.uint64)
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    slot = (mixed % np.uint64(DIMS_HASHED)).astype(np.int64)
    sign = np.where(mixed >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    return slot, sign, rng.standard_normal((DIMS_HASHED, DIMS))


def grid_cells(all_ids: list[np.ndarray], seed: int = SEED, size: int = 1 << 16) -> np.ndarray:
    """The grid cell (DIMS coordinates of BITS bits) of each document's ids."""
    slot, sign, matrix = _projection(seed, size)
    vectors = np.array([np.bincount(slot[i], weights=sign[i], minlength=DIMS_HASHED) for i in all_ids]).reshape(-1, DIMS_HASHED)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * (vectors @ matrix)))).astype(np.uint64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell on the Hilbert curve (Skilling, 2004), for all rows at once."""
    x = [c.astype(np.uint64).copy() for c in cells.T]
    zero, one = np.uint64(0), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for axis in x:
            hit = (axis & q) != 0
            swap = np.where(hit, zero, (x[0] ^ axis) & p)
            axis ^= swap
            x[0] ^= np.where(hit, p, swap) if axis is not x[0] else np.where(hit, p, zero)
    for a, b in zip(x, x[1:], strict=False):
        b ^= a
    flip = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), zero)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ flip) >> np.uint64(b)) & one)
    return key


def _token_batches(batches: Iterable[pa.RecordBatch], path: str, seed: int) -> Iterator[pa.RecordBatch]:
    coder = load(path)
    end = np.array([END_ID], coder.kind).tobytes()
    for b in in_parts(batches):
        ids = [coder.encode(t) + end for t in b.column(1).to_pylist()]
        arrays = [np.frombuffer(x, coder.kind) for x in ids]
        keys = hilbert_key(grid_cells(arrays, seed, max(coder.size, 1 << 16)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in arrays], pa.int64()), pa.array(keys.astype(np.int64)), pa.array(ids, pa.binary())], names=["doc_id", "n", "key", "ids"]
        )


def _running_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and the ids before a row in it, in the order of the rows."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = total + np.cumsum(n)
        if len(n):
            total = int(ends[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n)], names=["uid", "n", "part", "before"])


def _piece_batches(batches: Iterable[pa.RecordBatch], length: int, kind: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for b in in_parts(batches):
        rows: list[tuple] = []
        for doc_id, raw, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ids = np.frombuffer(raw, kind).astype("<u4")
            start = 0
            while start < len(ids):
                sequence, offset = divmod(at + start, length)
                size = min(length - offset, len(ids) - start)
                rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), sequence, offset))
                start += size
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)


def pack(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, path: str | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(spark)
    path = path or vocabulary_path(VOCABULARY)
    kind = load(path).kind
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    tokens = rows.mapInArrow(lambda it: _token_batches(it, path, seed), "doc_id long, n long, key long, ids binary")
    tokens = stage(spark, tokens.withColumn("uid", F.monotonically_increasing_id()), "pack-tokens")
    order = ["key", "doc_id", "uid"]
    ranged = tokens.select("uid", "n", "key", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "n")
    ranged = stage(spark, ranged.mapInArrow(_running_batches, "uid long, n long, part long, before long"), "pack-order")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("of_part"))  # one row per range
    base = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("of_part")
    totals = totals.select("part", base.alias("base"))
    places = ranged.join(F.broadcast(totals), "part").select("uid", (F.col("base") + F.col("before")).alias("at"))
    placed = tokens.select("uid", "doc_id", "ids").join(places.hint("merge"), "uid").select("doc_id", "ids", "at")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(lambda it: _piece_batches(it, length, kind), schema)
