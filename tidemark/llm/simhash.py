"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then the Hamming distance.

Fingerprint: words are runs of bytes other than ASCII white space, A-Z lowered; every run of
``width`` words, joined by a space, is hashed by XXH64 with seed 42; a bit of the fingerprint
is 1 if it is set in over half the hashes. Fewer words than ``width`` make one shingle; no
word makes fingerprint zero.

Links: the 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in at most
``distance`` bits differ in at most that many blocks, so they agree on at least
BLOCKS - distance of them: every choice of that many blocks is a key, and a linked pair
meets under at least one key. Only distinct fingerprints are keyed, so exact copies cost
nothing, and only keys that two or more fingerprints share go on. Inside a key the true
distance decides; a search from each member through the members not yet reached gives a
spanning forest, so a key of m fingerprints sends on at most m - 1 links, never all pairs.

Hot keys: a key shared by more than ``hot`` fingerprints is not given to one task. Its
fingerprints take an exact second way: two fingerprints lie within ``distance`` bits if and
only if some value lies within ceil(distance/2) bits of the one and floor(distance/2) bits
of the other, so each is spread to all values within the greater half. All that a value holds
are linked to the least of those within the lesser half, aggregated before the shuffle.

Edge cases: null text counts as empty, all documents without words link at fingerprint
zero; null ids take part and are never the smallest id unless a class has no other; repeated
rows come out alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage, text_bytes
from tidemark.llm.components import components

SEED, BLOCKS, HOT = 42, 6, 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) <= width:
        return xx(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    hashes = [xx(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    by_byte = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    n = len(hashes)
    if n < 64:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_batches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [_signed(fingerprint(t, width)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])


def _masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_keys(fp: Column, distance: int, blocks: int = BLOCKS) -> Column:
    """All keys of a fingerprint: the bits of each choice of blocks - distance blocks, hashed with its number."""
    keys = []
    for number, chosen in enumerate(combinations(_masks(blocks), blocks - distance)):
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(sum(chosen))))))
    return F.array(*keys)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of one key, under the distance."""
    links: list[tuple[int, int]] = []
    left = np.unique(fps)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                links.extend((int(x), int(at)) for x in found)
                frontier.extend(found)
    return links


def _link_batches(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (u, v)."""

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def groups(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        sizes = ends - starts
        twos = starts[sizes == 2]
        a, b = fps[twos], fps[twos + 1]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        links = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for i in np.flatnonzero(sizes > 2):
            links.extend(_forest(fps[starts[i] : ends[i]], distance))
        return links

    held_k, held_f = [], []
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        fps = fps.view(np.uint64)
        last = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
        if last:  # everything before the last key of this batch is whole
            held_k.append(keys[:last])
            held_f.append(fps[:last])
            if links := groups(np.concatenate(held_k), np.concatenate(held_f)):
                yield out(links)
            held_k, held_f = [], []
        elif held_k and held_k[-1][-1] != keys[0]:
            if links := groups(np.concatenate(held_k), np.concatenate(held_f)):
                yield out(links)
            held_k, held_f = [], []
        held_k.append(keys[last:])
        held_f.append(fps[last:])
    if held_k and (links := groups(np.concatenate(held_k), np.concatenate(held_f))):
        yield out(links)


def _half_masks(bits: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for k in range(bits + 1) for c in combinations(range(64), k)]


def hamming_links(spark: SparkSession, fps: DataFrame, distance: int = 4, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints ``fp`` within ``distance`` bits of one another."""
    ship(spark)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    shared = stage(spark, keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    members = stage(spark, keyed.join(shared, "key").select("key", "fp", "n"), "key-members")
    cold = members.where(F.col("n") <= hot).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    links = cold.mapInArrow(lambda it: _link_batches(it, distance), "u long, v long")
    heated = members.where(F.col("n") > hot).select("fp").distinct()
    if shared.where(F.col("n") > hot).limit(1).count():
        masks = _half_masks((distance + 1) // 2)
        spread = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count() <= distance // 2 if m >= 0 else (m + (1 << 64)).bit_count() <= distance // 2).alias("close")) for m in masks])).alias("x")
        near = heated.select("fp", spread).select("fp", F.col("fp").bitwiseXOR(F.col("x.mask")).alias("value"), "x.close")
        # a value within the lesser half of one and the greater half of another proves the two linked
        low = near.groupBy("value").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("m"), F.count(F.lit(1)).alias("n"))
        low = stage(spark, low.where("n > 1 AND m IS NOT NULL").select("value", "m"), "hot-values")
        links = links.union(near.join(low, "value").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())
    return links


def simhash_groups(
    spark: SparkSession,
    docs: DataFrame,
    distance: int = 4,
    width: int = 4,
    blocks: int = BLOCKS,
    hot: int = HOT,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id; ``with_text`` adds text_hash (XXH64 of the text) and class."""
    ship(spark)
    more = [F.xxhash64(text_col).alias("text_hash")] if with_text else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"), *more)
    made = "doc_id long, fp long" + (", text_hash long" if with_text else "")
    rows = stage(spark, rows.mapInArrow(lambda it: _fingerprint_batches(it, width), made), "fingerprints")
    fps = stage(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(spark, hamming_links(spark, fps.select("fp"), distance, blocks, hot))
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = stage(spark, classes.join(lowest, "root").select("fp", "component_id", "root"), "fingerprint-labels")
    extra = ["text_hash", F.col("root").alias("class")] if with_text else []
    return rows.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *extra)
