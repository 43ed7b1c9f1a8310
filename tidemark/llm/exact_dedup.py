"""Exact dedup over a cuckoo-filter index of live digests.

Method: the SHA-256 of the normalised text (A-Z lowered, null as empty) is looked up in a
partial-key cuckoo filter. A miss proves the text new. A hit is checked against the content
bucket that stores the live digests: only an equal digest is a copy, any other hit is a
false positive and goes in as new. When a copy with a larger id arrives, the live entry is
deleted from filter and bucket and the larger one is inserted. A filter that overflows is
rebuilt at twice the size from the stored keys.

The keys are stored whole beside the filter, for verification, deletion and resizing, so the
filter saves look-ups and no memory. A hit is verified on the stored SHA-256 of the
normalised text, as texts themselves do not travel: two texts of one SHA-256 count as equal.

Distribution: each task indexes its own rows first (so a group that holds a third of all
rows leaves a task as one row), the survivors are shuffled by digest and indexed again, and
the groups are joined back to the rows by digest, a join that Spark can split when skewed.
Memory is bounded: an index is emptied at FLUSH live entries, between two digests of the
sorted second pass or anywhere in the first.

Edge cases: null text equals empty text; null ids rank below all ids; among rows that
repeat both id and text exactly one is kept; an empty table gives an empty result; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage, text_bytes

FLUSH = 200_000


class CuckooFilter:
    """Partial-key cuckoo filter (Fan, Andersen, Kaminsky and Mitzenmacher, 2014)."""

    SLOTS = 4
    MAX_KICKS = 400

    def __init__(self, capacity: int = 1024):
        buckets = 4
        while buckets * self.SLOTS * 0.9 < capacity:
            buckets *= 2
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * buckets * self.SLOTS))
        self.live = 0
        self._turn = 0

    @staticmethod
    def _tag(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") % 65535 + 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = self._tag(digest)
        first = int.from_bytes(digest[:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x9E3779B1)) & self.mask

    def _put(self, bucket: int, tag: int) -> bool:
        at = bucket * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if not self.tags[i]:
                self.tags[i] = tag
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        tag, a, b = self._places(digest)
        s = self.SLOTS
        return tag in self.tags[a * s : a * s + s] or tag in self.tags[b * s : b * s + s]

    def insert(self, digest: bytes) -> bool:
        """False if the table is too full; the caller then rebuilds it from its keys."""
        tag, a, b = self._places(digest)
        if self._put(a, tag) or self._put(b, tag):
            self.live += 1
            return True
        at = b
        for _ in range(self.MAX_KICKS):
            self._turn += 1
            i = at * self.SLOTS + self._turn % self.SLOTS
            tag, self.tags[i] = self.tags[i], tag
            at = self._other(at, tag)
            if self._put(at, tag):
                self.live += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        tag, a, b = self._places(digest)
        for bucket in (a, b):
            at = bucket * self.SLOTS
            for i in range(at, at + self.SLOTS):
                if self.tags[i] == tag:
                    self.tags[i] = 0
                    self.live -= 1
                    return True
        return False


class DigestIndex:
    """Live digests with the row to keep and the group size; the filter answers first."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[int, list[tuple]] = {}
        self.size = 0
        self.resizes = 0

    @staticmethod
    def _bucket(digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "little")

    def find(self, digest: bytes) -> tuple | None:
        if digest not in self.filter:
            return None
        return next((e for e in self.buckets.get(self._bucket(digest), ()) if e[0] == digest), None)

    def insert(self, digest: bytes, keep: tuple, count: int) -> None:
        self.buckets.setdefault(self._bucket(digest), []).append((digest, keep, count))
        self.size += 1
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> None:
        at = self._bucket(digest)
        left = [e for e in self.buckets[at] if e[0] != digest]
        if left:
            self.buckets[at] = left
        else:
            del self.buckets[at]
        self.size -= 1
        self.filter.delete(digest)

    def add(self, digest: bytes, keep: tuple, count: int = 1) -> None:
        """``keep`` is an orderable rank of the row; the largest of a group stays live."""
        live = self.find(digest)
        if live is not None:
            self.delete(digest)
            keep, count = max(keep, live[1]), count + live[2]
        self.insert(digest, keep, count)

    def _resize(self) -> None:
        self.resizes += 1
        capacity = 2 * (self.filter.mask + 1) * CuckooFilter.SLOTS
        while True:
            self.filter = CuckooFilter(capacity)
            if all(self.filter.insert(e[0]) for b in self.buckets.values() for e in b):
                return
            capacity *= 2

    def drain(self) -> Iterator[tuple]:
        for bucket in self.buckets.values():
            yield from bucket


_DIGESTS = "doc_id long, uid long, text_hash long, digest binary"
_GROUPS = "digest binary, keep_id long, keep_uid long, group_size long"
_GROUP_FIELDS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(t.lower()).digest() for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.binary())], names=["doc_id", "uid", "text_hash", "digest"])


def _rank(doc_id: int | None, uid: int) -> tuple:
    return (doc_id is not None, doc_id or 0, uid)


def _emit(index: DigestIndex) -> pa.RecordBatch:
    rows = list(index.drain())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.binary()),
            pa.array([r[1][1] if r[1][0] else None for r in rows], pa.int64()),
            pa.array([r[1][2] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        schema=_GROUP_FIELDS,
    )


def _index_batches(batches: Iterable[pa.RecordBatch], flush: int, is_sorted: bool) -> Iterator[pa.RecordBatch]:
    """Rows (digest, id, uid, count) to one row per digest; sorted input is flushed between digests only."""
    index, last = DigestIndex(), None
    for b in batches:
        for digest, doc_id, uid, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if index.size >= flush and (not is_sorted or digest != last):
                yield _emit(index)
                index = DigestIndex()
            index.add(digest, _rank(doc_id, uid), count)
            last = digest
    if index.size:
        yield _emit(index)


def digest_groups(rows: DataFrame, flush: int = FLUSH) -> DataFrame:
    """One row per distinct digest of rows (doc_id, uid, digest): what stays, and the size."""
    local = rows.select("digest", "doc_id", "uid", F.lit(1).cast("long").alias("n"))
    local = local.mapInArrow(lambda it: _index_batches(it, flush, False), _GROUPS)
    dealt = local.repartition("digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(lambda it: _index_batches(it, flush, True), _GROUPS)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash (XXH64 of the text as it is)."""
    ship(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(text_col).alias("text_hash"), text_bytes(text_col).alias("t")
    )
    rows = stage(spark, rows.mapInArrow(_digest_batches, _DIGESTS), "digests")
    groups = stage(spark, digest_groups(rows, flush), "digest-groups")
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )
