"""Exact top-k search by inner product over an impact-ordered index.

Method: components become integers floor(scale * x). The index of a block of vectors holds,
for every dimension, its postings (vector, component) by impact, the size of the component,
quantised to LEVELS levels. Queries go score at a time: the segments of the highest level of
all dimensions first, then the next, adding to accumulators. After a level, what is still to
come for a pair is at most the length of the vector's unprocessed components times the length
of the query in just these dimensions (Cauchy and Schwarz), and at most the next level's impact
times the sum of the query's sizes. With the k-th best score proved so far this bounds the
possible members; as soon as scoring these exactly costs no more than the segments left, the
scan stops, and the possible members, and no others, are scored. Without such proof all
segments are processed and the accumulators are exact.

Distribution: index blocks are dealt to groups of PER_GROUP blocks. A task indexes each block of its group
once, holds these indexes, and streams all blocks of queries past them, so no index block is
copied or indexed twice; it carries the scores proved for a block of queries from one index
to the next, and returns at most k rows for each query and group.

Edge cases: vectors that are null or hold null or non-finite components take no part; an empty
vector takes part with score zero; a row is no candidate for itself, but other rows of the same
id are; rows without id are candidates, last among ties, and no queries; rows that repeat a
query are queries of their own; of unequal lengths the missing components count as zero; ties
go to the smaller id; fewer candidates than k are all returned; an empty table gives an empty
result; other columns are ignored. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stage

LEVELS, BLOCK, QUERIES, SCALE, TOP, EVERY = 16, 4096, 256, 1024, 10, 100
PER_GROUP = 16
#: Pairs that are scored exactly at a time.
CHUNK = 1 << 16


class ImpactBlock:
    """Postings of a block of integer vectors, in segments (level, dimension) by descending level."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, levels: int = LEVELS):
        self.ids, self.matrix = ids, matrix
        size = np.abs(matrix.astype(np.float64))
        top = size.max(initial=0.0)
        self.step = max(top / levels, 1e-300)
        level = np.minimum(np.ceil(size / self.step), levels).astype(np.int64)  # 0: a zero component, in no segment
        rows, dims = np.nonzero(level)
        depth = level[rows, dims]
        order = np.lexsort((rows, dims, -depth))
        self.rows, dims, depth = rows[order].astype(np.int32), dims[order], depth[order]
        self.values = matrix[self.rows, dims]
        change = np.flatnonzero((np.diff(depth) != 0) | (np.diff(dims) != 0)) + 1
        bounds = np.concatenate(([0], change, [len(depth)])) if len(depth) else np.zeros(1, np.int64)
        self.segments: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            self.segments.setdefault(int(depth[a]), []).append((int(dims[a]), a, b))
        self.levels = sorted(self.segments, reverse=True)
        squares = self.values.astype(np.float64) ** 2
        left = np.bincount(self.rows, weights=squares, minlength=len(ids))
        self.length = np.sqrt(left)
        self.left: dict[int, np.ndarray] = {}  # squared length of the components below a level
        for x in self.levels:
            a, b = self.segments[x][0][1], self.segments[x][-1][2]
            left = left - np.bincount(self.rows[a:b], weights=squares[a:b], minlength=len(ids))
            self.left[x] = np.maximum(left, 0.0) + 1e-9 * self.length**2  # and what rounding may have taken


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each column; minus infinity if there are fewer."""
    if len(scores) < k:
        return np.full(scores.shape[1], -np.inf)
    return np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]


def _exact(matrix: np.ndarray, rows: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The scores of pairs, a chunk of them at a time."""
    cuts = range(0, len(rows), CHUNK)
    return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", matrix[rows[c : c + CHUNK]], queries[at[c : c + CHUNK]]) for c in cuts)])


def search_block(block: ImpactBlock, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, row, score) of pairs that may be in a top k, and the levels scanned.

    ``query_ids`` name rows as ``block.ids`` does; ``floor``: for each query a score that k candidates are known to reach.
    """
    q = queries.astype(np.float64)
    energy, total = (q**2).sum(axis=1), np.abs(q).sum(axis=1)
    slack = 1 + 1e-12 * block.length[:, None] * np.sqrt(energy)[None, :]  # of sums in floating point
    acc = np.zeros((len(block.ids), len(query_ids)), np.int64)
    met = np.zeros(acc.shape)  # squared length of the query in the dimensions that are done for a vector
    own = block.ids[:, None] == query_ids[None, :]
    columns, squares = np.ascontiguousarray(queries.T), np.ascontiguousarray((q**2).T)
    scanned, to_come = 0, len(block.values)
    for number, level in enumerate(block.levels):
        for d, a, b in block.segments[level]:
            acc[block.rows[a:b]] += block.values[a:b, None] * columns[d][None, :]
            met[block.rows[a:b]] += squares[d][None, :]
            to_come -= b - a
        scanned += 1
        if number + 1 == len(block.levels):
            break
        after = block.levels[number + 1] * block.step
        unmet = np.maximum(energy[None, :] - met, 0.0) + 1e-9 * energy[None, :]
        rest = np.minimum(np.sqrt(block.left[level][:, None] * unmet), after * total[None, :]) + slack
        floor = np.maximum(floor, _kth(np.where(own, -np.inf, acc - rest), k))
        possible = ~own & (acc + rest >= floor[None, :])
        if np.count_nonzero(possible) * queries.shape[1] <= to_come * len(query_ids):
            rows, at = np.nonzero(possible)
            return at, rows, _exact(block.matrix, rows, queries, at), scanned
    floor = np.maximum(floor, _kth(np.where(own, -np.inf, acc - slack), k))
    rows, at = np.nonzero(~own & (acc + slack >= floor[None, :]))
    return at, rows, acc[rows, at], scanned


def _best(at: np.ndarray, unknown: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query number."""
    order = np.lexsort((ids, unknown, -scores, at))
    sorted_at = at[order]
    first = np.searchsorted(sorted_at, sorted_at, side="left")
    return order[np.arange(len(order)) - first < k]


_BLOCKS = pa.schema([("uids", pa.binary()), ("ids", pa.binary()), ("unknown", pa.binary()), ("matrix", pa.binary()), ("width", pa.int32())])
_BLOCK_ROWS = "uids binary, ids binary, unknown binary, matrix binary, width int"


class _Vectors:
    """Rows of vectors: a number for each row, its id (zero and ``unknown`` where it has none), and the components."""

    def __init__(self, uids: list[int], ids: list[int | None], rows: list[list[int]]):
        self.uids = np.array(uids, np.int64)
        self.unknown = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.matrix = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
        for k, r in enumerate(rows):
            self.matrix[k, : len(r)] = r

    @classmethod
    def read(cls, uids: bytes, ids: bytes, unknown: bytes, matrix: bytes, width: int) -> _Vectors:
        made = cls.__new__(cls)
        made.uids, made.ids, made.unknown = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(unknown, bool)
        made.matrix = np.frombuffer(matrix, np.int64).reshape(len(made.uids), width)
        return made

    def where(self, chosen: np.ndarray) -> _Vectors:
        made = _Vectors.__new__(_Vectors)
        made.uids, made.ids, made.unknown, made.matrix = self.uids[chosen], self.ids[chosen], self.unknown[chosen], self.matrix[chosen]
        return made

    def wide(self, width: int) -> np.ndarray:
        """The components cut or filled with zeros to a width."""
        out = np.zeros((len(self.uids), width), np.int64)
        shared = min(width, self.matrix.shape[1])
        out[:, :shared] = self.matrix[:, :shared]
        return out

    def batch(self) -> pa.RecordBatch:
        cells = [self.uids.tobytes(), self.ids.tobytes(), self.unknown.tobytes(), self.matrix.tobytes(), self.matrix.shape[1]]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _BLOCKS, strict=True)], schema=_BLOCKS)


def _block_batches(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (uid, vec_id, components) to blocks."""
    held: list[list] = [[], [], []]
    for b in batches:
        for column, more in zip(held, b.columns, strict=True):
            column += more.to_pylist()
        while len(held[0]) >= block:
            yield _Vectors(*(c[:block] for c in held)).batch()
            held = [c[block:] for c in held]
    if held[0]:
        yield _Vectors(*held).batch()


def _query_batches(batches: Iterable[pa.RecordBatch], every: int, per: int) -> Iterator[pa.RecordBatch]:
    """The queries among the vectors of blocks, in blocks of about ``per``."""
    held: list[_Vectors] = []

    def out() -> pa.RecordBatch:
        made = _Vectors.__new__(_Vectors)
        width = max(h.matrix.shape[1] for h in held)
        made.matrix = np.concatenate([h.wide(width) for h in held])
        made.uids, made.ids, made.unknown = (np.concatenate([getattr(h, c) for h in held]) for c in ("uids", "ids", "unknown"))
        held.clear()
        return made.batch()

    for b in batches:
        for cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            whole = _Vectors.read(*cells)
            asked = whole.where(~whole.unknown & (whole.ids % every == 0))
            for at in range(0, len(asked.uids), per):
                held.append(asked.where(np.arange(at, min(at + per, len(asked.uids)))))
                if sum(len(h.uids) for h in held) >= per:
                    yield out()
    if held:
        yield out()


def _search_batches(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, kind, number, block) in that order to candidates: kind 0 is a block to index, kind 1 a block of queries."""
    group, indexes = None, []
    for batch in batches:
        for j in range(batch.num_rows):
            g, kind, _, *cells = (c[j].as_py() for c in batch.columns)
            if g != group:
                group, indexes = g, []
            block = _Vectors.read(*cells)
            if kind == 0:
                indexes.append((block, ImpactBlock(block.uids, block.matrix)))
                continue
            n = len(block.uids)
            floor, held = np.full(n, -np.inf), []
            best = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # query, id, score, unknown
            for vectors, index in indexes:
                # components beyond the width of the index meet zeros
                at, rows, scores, _ = search_block(index, block.uids, block.wide(vectors.matrix.shape[1]), k, floor)
                held = [np.concatenate(x) for x in zip(best, (at, vectors.ids[rows], scores, vectors.unknown[rows]), strict=True)]
                kept = _best(held[0], held[3], held[1], held[2], k)
                best = [x[kept] for x in held]
                # the k best scores so far of each query are proof for the blocks to come
                rank = np.arange(len(kept)) - np.searchsorted(best[0], best[0], side="left")
                last = rank == k - 1
                proved = best[2][last].astype(np.float64)
                floor[best[0][last]] = np.maximum(floor[best[0][last]], proved - 1 - 1e-12 * np.abs(proved))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.uids[best[0]]), pa.array(block.ids[best[0]]), pa.array(best[1], mask=best[3]), pa.array(best[2])], names=["q", "query_id", "vec_id", "score"]
            )


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    k: int = TOP,
    every: int = EVERY,
    scale: int = SCALE,
    block: int = BLOCK,
    queries_per_block: int = QUERIES,
    per_group: int = PER_GROUP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``every``."""
    ship(spark)
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(whole).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))
    blocks = rows.mapInArrow(lambda it: _block_batches(it, block), _BLOCK_ROWS)
    blocks = stage(spark, blocks.withColumn("number", F.monotonically_increasing_id()), "impact-blocks")
    asked = blocks.drop("number").mapInArrow(lambda it: _query_batches(it, every, queries_per_block), _BLOCK_ROWS)
    asked = stage(spark, asked.withColumn("number", F.monotonically_increasing_id()), "query-blocks")

    n_blocks = blocks.count()
    groups = max(1, min(n_blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n_blocks // per_group))
    to_index = blocks.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "number", *_BLOCKS.names)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    dealt = to_index.union(asked.select(every_group, F.lit(1).alias("kind"), "number", *_BLOCKS.names))
    dealt = dealt.repartition("g").sortWithinPartitions("g", "kind", "number")
    found = dealt.mapInArrow(lambda it: _search_batches(it, k), "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
