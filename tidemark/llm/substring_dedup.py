"""Substring dedup by line and paragraph hashing.

Method: a text is cut into lines, and lines into sentences (after ., ! or ? with blanks behind
it), as passages are often set into a line. Units are paragraphs of whole lines and paragraphs
of whole sentences: from each line, and from each sentence, the shortest run of whole lines,
or of whole sentences, that holds ``min_words`` words. With ``min_words`` 1 every line and
every sentence is a unit of its own. A word counts once, and once more for each further
WORD_BYTES bytes, for scripts without spaces. Units are normalised (A-Z lowered, white space runs to one
space, ends trimmed) and digested (128 bits of BLAKE2b). Digests are grouped globally; the
occurrence that ranks first (smallest document, then earliest start) stays, and every later
one is removed whole, whatever surrounds it. Nothing else goes: each byte removed lies in a
unit that occurs earlier. Spans are reported in bytes of the original text.

Distribution: texts are digested once, into a written table of 32 bytes a unit. Digests are
counted with partial aggregation, so a line in a third of all documents is one row per task;
only digests that occur twice go on, and they are joined back by a join that Spark can split
when skewed. Only documents with a repeat are cut.

Edge cases: null text stays null; an empty text has no units; null ids rank first; rows that
repeat both id and text are one document: they are cut alike and are no repeats of each
other; rows with equal ids and other texts rank by a hash of the text; the last lines of a
text that hold fewer than ``min_words`` words together start no unit, but may end one; an
empty table gives an empty result; other columns keep their values, whatever their names, but
one named removed_spans is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import in_parts
from tidemark.llm.common import ship, stage, text_bytes

MIN_WORDS, WORD_BYTES = 30, 15
_CUT = re.compile(rb"[\r\n]|[.!?][ \t]+")


def _runs(starts: list[int], before: list[int], total: int, min_words: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the shortest run of parts from each part that holds ``min_words`` words.

    ``starts``: the first sentence of each part, and the end of the last one; ``before``: words before each sentence.
    """
    end = 0
    for k, first in enumerate(starts[:-1]):
        want = before[first] + min_words
        end = max(end, k + 1)
        while (before[starts[end]] if starts[end] < len(before) else total) < want:
            end += 1
            if end == len(starts):
                return
        yield first, starts[end]


def units(text: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised text) of each unit by start, then end; white space behind a unit is its own."""
    spans, norms, before, lines = [], [], [], []  # of the sentences that hold words
    at = total = 0
    new_line = True
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        words = text[at:end].lower().split()
        if words:
            if new_line:
                lines.append(len(spans))
                new_line = False
            spans.append((at, end))
            norms.append(b" ".join(words))
            before.append(total)
            total += len(words) if max(map(len, words)) < WORD_BYTES else sum(1 + len(w) // WORD_BYTES for w in words)
        new_line = new_line or text[end - 1 : end] in (b"\n", b"\r")
        at = end
    n = len(spans)
    found = {*_runs([*lines, n], before, total, min_words), *_runs(list(range(n + 1)), before, total, min_words)} if n else ()
    return [(spans[a][0], spans[b - 1][1], b" ".join(norms[a:b])) for a, b in sorted(found)]


def removed_spans(text: bytes, repeats: set[int], min_words: int) -> list[tuple[int, int]]:
    """Maximal spans covered by the units of these numbers."""
    spans: list[tuple[int, int]] = []
    for k, (start, end, _) in enumerate(units(text, min_words)):
        if k in repeats:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
    return spans


def _unit_batches(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Texts to their digested units; place: 32 bits of the text's hash and the number of the unit."""
    names = ["doc_id", "place", "hi", "lo"]
    blake = hashlib.blake2b
    for b in in_parts(batches):
        ids: list[int | None] = []
        places: list[int] = []
        digests: list[bytes] = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = [blake(norm, digest_size=16).digest() for _, _, norm in units(text, min_words)]
            ids += [doc_id] * len(found)
            base = (key >> 32) << 32
            places += range(base, base + len(found))
            digests += found
        two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut_batches(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Adds the cut text and the removed spans; text and units are the last two columns."""
    for b in in_parts(batches):
        texts, spans = [], []
        for text, repeats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            gone = removed_spans(text, set(repeats), min_words) if text is not None and repeats else []
            at, kept = 0, []
            for start, end in gone:
                kept.append(text[at:start])
                at = end
            texts.append(text if not gone else b"".join([*kept, text[at:]]))
            spans.append([{"start": x, "end": y} for x, y in gone])
        cut = pa.array(texts, pa.binary())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*b.columns[2:], cut, pa.array(spans, kind)], names=[*b.schema.names[2:], "cut", "spans"])


def repeated_units(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, repeats): the numbers of the units of a document that occur earlier; key: the high half of the text's hash."""
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), text_bytes(text_col).alias("t"))
    found = rows.mapInArrow(lambda it: _unit_batches(it, min_words), "doc_id long, place long, hi long, lo long")
    found = stage(spark, found, "units")
    place = F.struct("doc_id", "place")
    first = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", "first")
    first = stage(spark, first, "repeated-units")
    later = found.join(first.hint("merge"), ["hi", "lo"]).where(~place.eqNullSafe(F.col("first")))
    unit = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return later.groupBy("doc_id", F.shiftright("place", 32).alias("key")).agg(F.collect_set(unit).alias("repeats"))


def substring_dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut, and removed_spans: array<struct<start,end>> in bytes of the original text."""
    repeats = stage(spark, repeated_units(spark, docs, min_words, id_col, text_col), "repeats").select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "repeats")
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    flat = docs.toDF(*names)
    id_at, text_at = (names[docs.columns.index(c)] for c in (id_col, text_col))
    same = F.col(id_at).cast("long").eqNullSafe(F.col("r_id")) & (F.shiftright(F.xxhash64(text_at), 32) == F.col("r_key"))
    other = [c for c in names if c != text_at]
    joined = flat.join(repeats.hint("merge"), same, "left").select(F.col(text_at).cast("binary").alias("t"), "repeats", *other)
    types = "".join(f"{c} {flat.schema[c].dataType.simpleString()}, " for c in other)
    made = joined.mapInArrow(lambda it: _cut_batches(it, min_words), f"{types}cut binary, spans array<struct<start:long,end:long>>")
    made = made.withColumn(text_at, F.col("cut").cast("string"))
    before = [(c, n) for c, n in zip(docs.columns, names, strict=True) if c != "removed_spans"]
    return made.select(*[n for _, n in before], "spans").toDF(*[c for c, _ in before], "removed_spans")
