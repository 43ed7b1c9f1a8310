"""Removal of repeated substrings by suffix arrays.

A byte goes if it is covered by a string of ``width`` bytes that also starts earlier: in a
document of smaller id, or earlier in the same one. Strings are judged on the input.

Method: windows of ``width`` bytes are dealt to shards by content, shards are sorted by
induced sorting (``suffix_array``), and the permuted common prefixes of a shard tell which
windows are equal; of equal windows all but the earliest are marked.

Dealing: each window has an anchor, its leftmost substring of K bytes of least hash. It
depends on the window alone, so equal windows have equal anchors. Windows that share one
anchor position make a segment. Anchors are counted in numeric blocks, one per shuffle bucket:

* of segments that agree in 128 bits of hash, all but the earliest claim to be copies of it. This
  happens inside each task before the shuffle, so a passage in a third of all documents is
  one entry per task, and again after it. A claim marks nothing yet: claims that follow one
  another make runs, runs are cut at every SPAN bytes of the document they copy, and the
  bytes of both sides are compared; a claim that fails ends the job. Of runs of one place with
  the same bytes a task sends one, so a span copied by many documents gets few pieces a task;
* an anchor met in one kind of segment only has no other repeats;
* the earliest of each kind of an anchor with several kinds is fetched and sorted in a shard;
* an anchor with over HOT kinds of segments (a short common line in ever new surroundings)
  is not given to one shard: each of its windows is dealt by its own digest (128 bits of
  BLAKE2b) and settled by it. One that shows over HOT / LOCAL kinds inside a task already is
  not gathered in its bucket either: the bucket gets a flag in place of the entries.

Distribution: the texts are read three times: for anchors, for the segments and runs to
fetch, and for the result; they are joined with the few entries that concern them by id and
hash. All shuffles are by hash; no step holds more than a bucket or a shard of SHARD bytes. On disk
lie the shuffles of one step and the tables it reads and writes: those of earlier steps are deleted.

Edge cases: null text counts as empty; texts shorter than ``width`` lose nothing; null ids are
the earliest; rows of equal id and other text are ordered by a hash of the text; rows that
repeat both id and text are one document and come out alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import in_parts
from tidemark.llm.common import drop, ship, stage, text_bytes
from tidemark.llm.suffix_array import permuted_lcp, suffix_array

WIDTH, K, HOT = 100, 32, 256
SHARD, FLUSH, CHUNK = 1 << 20, 1 << 20, 1 << 19
MARK, FETCH, WINDOWS, FLAG, CLAIM, LEAD, VERIFY = range(7)
#: Runs of copies are compared in pieces of so many bytes of what they copy.
SPAN = 1 << 12
#: A task remembers the copies it sent up to so many bytes.
SENT = 1 << 22
#: An anchor with over HOT / LOCAL kinds of segments in one flush of one task is hot at once.
LOCAL = 16
NO_ID = -(1 << 63)
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("rid", "<i8"), ("key", "<i8"), ("s", "<i4"), ("m", "<i4"), ("t", "<i4")])
#: A claim names the document it copies in a and b, and where in t.
_ROWS = "kind int, a long, b long, rid long, key long, s int, m int, t int"
_PACKED = "bucket int, kind int, payload binary"
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position, from hashes of powers of two."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _MUL
    size = 1
    while size < k:
        step = min(size, k - size)
        n = len(h) - step
        h = (h[:n] * _MUL2 + (h[step:] ^ (h[step:] >> np.uint64(29)))) * _MUL
        h ^= h >> np.uint64(32)
        size += step
    return h


def _least(x: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while size < span:
        step = min(size, span - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def segments(text: bytes, width: int = WIDTH, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, windows) of the segments of a text, in chunks of it."""
    for base in range(0, max(len(text) - width + 1, 0), CHUNK):
        x = np.frombuffer(text, np.uint8, count=min(CHUNK + width - 1, len(text) - base), offset=base)
        h = _hashes(x, k)
        ranked = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(ranked, width - k + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        yield h[at[starts]], base + starts, np.diff(np.concatenate((starts, [len(at)])))


def _settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (a, b) and place: the earliest of each kind, the rest, and for each of these the earliest."""
    e = e[np.lexsort((e["s"], e["key"], e["rid"], e["b"], e["a"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    # a repeated row of the table is no earlier place
    same = (e["rid"] == e["rid"][lead]) & (e["key"] == e["key"][lead]) & (e["s"] == e["s"][lead])
    return e[new], e[~new & ~same], e[lead[~new & ~same]]


def _claims(copies: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The copies as claims, and the segments they copy."""
    claims = copies.copy()
    claims["a"], claims["b"], claims["t"] = leads["rid"].astype(np.int64).view(np.uint64), leads["key"].astype(np.int64).view(np.uint64), leads["s"]
    own = np.zeros(len(leads), _ENTRY)
    for c in ("rid", "key", "s", "m"):
        own[c] = leads[c]
    own["t"] = leads["s"]
    return claims, np.unique(own)


def _span_keys(rid: np.ndarray, key: np.ndarray, span: np.ndarray) -> np.ndarray:
    h = (rid.astype(np.int64).view(np.uint64) * _MUL) ^ key.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MUL2 + span.astype(np.uint64)
    return ((h ^ (h >> np.uint64(29))) * _MUL).view(np.int64)


def _pack(e: np.ndarray, buckets: int, kind: int, by_document: bool = False) -> pa.RecordBatch:
    """One row for each bucket, by anchor, or by document (id and text) for entries that only pass through."""
    dealt = _span_keys(e["rid"], e["key"], np.zeros(len(e), np.int64)).view(np.uint64) if by_document else np.ascontiguousarray(e["a"])
    bucket = (dealt % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    e, bucket = e[order], bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(e)]
    columns = [b"".join(e[c][x:y].tobytes() for c in _ENTRY.names) for x, y in zip(cuts, cuts[1:], strict=False)]
    numbers = bucket[cuts[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([kind] * len(numbers), pa.int32()), pa.array(columns, pa.binary())], names=["bucket", "kind", "payload"])


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // _ENTRY.itemsize
    e, at = np.empty(n, _ENTRY), 0
    for c in _ENTRY.names:
        size = n * _ENTRY[c].itemsize
        e[c] = np.frombuffer(raw, _ENTRY[c], count=n, offset=at)
        at += size
    return e


def _out(kind: int, e: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(e), kind), pa.int32()), *(pa.array(np.ascontiguousarray(e[c]).view(np.int64)) for c in ("a", "b"))]
    columns += [pa.array(np.ascontiguousarray(e[c])) for c in ("rid", "key", "s", "m", "t")]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "rid", "key", "s", "m", "t"])


class _Packer:
    """Collects entries; settles and packs them when full.

    An anchor with over ``local`` kinds in one flush is hot: a flag tells its bucket so, and its
    entries go on to be dealt by window, over buckets by document, so none gathers them.
    """

    def __init__(self, buckets: int, local: int | None = None):
        self.buckets, self.local, self.held, self.size = buckets, local, [], 0

    def add(self, e: np.ndarray) -> None:
        self.held.append(e)
        self.size += len(e)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        first, copies, leads = _settle(np.concatenate(self.held))
        self.held, self.size = [], 0
        later = [(copies, MARK)]  # of windows by their digest
        if self.local is not None:
            claims, own = _claims(copies, leads)
            later = [(claims, CLAIM), (own, LEAD)]
            anchors, which, kinds = np.unique(first["a"], return_inverse=True, return_counts=True)
            hot = kinds > self.local
            if hot.any():
                flags = np.zeros(int(hot.sum()), _ENTRY)
                flags["a"] = anchors[hot]
                yield _pack(flags, self.buckets, FLAG)
                yield _pack(first[hot[which]], self.buckets, WINDOWS, by_document=True)
                first = first[~hot[which]]
        for rows, kind in ((first, FETCH), *later):
            if len(rows):
                yield _pack(rows, self.buckets, kind, by_document=kind != FETCH)


def _entries(a: np.ndarray, b: np.ndarray, rid: int, key: int, s: np.ndarray, m: np.ndarray) -> np.ndarray:
    e = np.empty(len(a), _ENTRY)
    e["a"], e["b"], e["rid"], e["key"], e["s"], e["m"], e["t"] = a, b, rid, key, s, m, 0
    return e


def _anchor_batches(batches: Iterable[pa.RecordBatch], width: int, buckets: int, hot: int) -> Iterator[pa.RecordBatch]:
    packer, xx = _Packer(buckets, hot // LOCAL), xxhash.xxh64_intdigest
    for batch in in_parts(batches):
        for rid, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a, s, m in segments(text, width):
                ends = (s + m + (width - 1)).tolist()
                b = np.array([xx(text[x:y]) for x, y in zip(s.tolist(), ends, strict=True)], np.uint64)
                packer.add(_entries(a, b, rid, key, s, m))
        if packer.size >= FLUSH:
            yield from packer.flush()
    yield from packer.flush()


def _settle_bucket(held: list[bytes], flags: list[bytes], hot: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    first, copies, leads = _settle(np.concatenate([_unpack(x) for x in held]))
    if len(copies):
        claims, own = _claims(copies, leads)
        yield _out(CLAIM, claims)
        yield _out(LEAD, own)
    _, which, kinds = np.unique(first["a"], return_inverse=True, return_counts=True)
    kinds = kinds[which]
    by_window = kinds > hot
    if flags:
        by_window |= np.isin(first["a"], np.concatenate([_unpack(x)["a"] for x in flags]))
    for kind, rows in ((FETCH, first[(kinds > 1) & ~by_window]), (WINDOWS, first[by_window])):
        if len(rows):
            yield _out(kind, rows)


def _bucket_batches(batches: Iterable[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket to rows of claims and what they copy, segments to fetch, and segments to deal by window."""
    held: list[bytes] = []
    flags: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last:
                yield from _settle_bucket(held, flags, hot)
                held, flags, last = [], [], bucket
            if kind == FETCH:
                held.append(payload)
            elif kind == FLAG:
                flags.append(payload)
            else:
                yield _out(kind, _unpack(payload))
    yield from _settle_bucket(held, flags, hot)


_PIECES = "shard long, kind int, a long, rid long, key long, s int, seg binary"


def _runs(doc: np.ndarray, e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Claims and led segments of the documents of a batch as runs, cut where a span of what is copied ends.

    (document, key of the span, place in the document or -1 for what is copied, place in the span, start, windows)
    """
    led, shift = e["kind"] == LEAD, e["t"].astype(np.int64) - e["s"]
    order = np.lexsort((e["s"], shift, e["b"], e["a"], led, doc))
    doc, led, shift, a, b, s, m = (x[order] for x in (doc, led, shift, e["a"], e["b"], e["s"].astype(np.int64), e["m"].astype(np.int64)))
    new = np.ones(len(s), bool)
    same = (doc[1:] == doc[:-1]) & (led[1:] == led[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (shift[1:] == shift[:-1])
    new[1:] = ~same | (s[1:] > s[:-1] + m[:-1])
    first = np.flatnonzero(new)
    end = (s + m)[np.append(first[1:], len(s)) - 1]
    doc, led, shift, a, b, s = (x[first] for x in (doc, led, shift, a, b, s))
    low, high = s + shift, end + shift
    pieces = (high - 1) // SPAN - low // SPAN + 1
    row = np.repeat(np.arange(len(s)), pieces)
    span = low[row] // SPAN + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low, high = np.maximum(low[row], span * SPAN), np.minimum(high[row], (span + 1) * SPAN)
    start = low - shift[row]
    return doc[row], _span_keys(a[row], b[row], span), np.where(led[row], -1, start), low - span * SPAN, start, high - low


_NAMES = ["shard", "kind", "a", "rid", "key", "s", "t", "seg"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_PIECES = "shard long, kind int, a long, rid long, key long, s int, t int, seg binary"


def _fetch_batches(batches: Iterable[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts with their entries to segments for the shards, pieces to compare, and packed windows for the buckets.

    Of copies of one place that have the same bytes, the task sends one to be compared; the others are marked, as they
    were compared with that one here and a copy that fails ends the job.
    """
    packer, proven, sent, size, waiting = _Packer(buckets), [], set(), 0, 0

    def windows() -> Iterator[pa.RecordBatch]:
        marks = [_pack(np.concatenate(proven), buckets, MARK, by_document=True)] if proven else []
        proven.clear()
        for p in (*packer.flush(), *marks):
            zero = pa.array([0] * p.num_rows, pa.int64())
            kinds = pa.array([WINDOWS if k == FETCH else MARK for k in p.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([p.column(0).cast(pa.int64()), kinds, zero, zero, zero, zero.cast(pa.int32()), zero.cast(pa.int32()), p.column(2)], names=_NAMES)

    for batch in in_parts(batches):
        rid, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        texts, lists = batch.column(2).to_pylist(), batch.column(3)
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        e = {c: flat.field(k).to_numpy(zero_copy_only=False) for k, c in enumerate(("kind", "a", "b", "s", "m", "t"))}

        def cut(d: np.ndarray, start: np.ndarray, m: np.ndarray) -> list[bytes]:
            ends = (start + m + (width - 1)).tolist()
            return [texts[i][x:y] for i, x, y in zip(d.tolist(), start.tolist(), ends, strict=True)]  # noqa: B023

        def rows(kind: int, d: np.ndarray, a: np.ndarray, s: np.ndarray, t: np.ndarray, seg: list[bytes]) -> pa.RecordBatch:
            columns = [a, np.full(len(d), kind), a, rid[d], key[d], s, t, seg]  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, _TYPES, strict=True)], names=_NAMES)

        at = np.flatnonzero(e["kind"] == FETCH)
        if len(at):
            yield rows(FETCH, doc[at], e["a"][at], e["s"][at], np.zeros(len(at), np.int64), cut(doc[at], e["s"][at], e["m"][at]))
        at = np.flatnonzero((e["kind"] == CLAIM) | (e["kind"] == LEAD))
        if len(at):
            chosen = {c: x[at] for c, x in e.items()}
            d, led = doc[at], chosen["kind"] == LEAD
            chosen["a"], chosen["b"] = np.where(led, rid[d], chosen["a"]), np.where(led, key[d], chosen["b"])
            d, span, place, t, start, m = _runs(d, chosen)
            seg, first = cut(d, start, m), np.ones(len(d), bool)
            for k, (own, piece) in enumerate(zip(place.tolist(), zip(span.tolist(), t.tolist(), seg, strict=True), strict=True)):
                if own >= 0:
                    first[k] = piece not in sent
                    sent.add(piece)
            size += sum(map(len, seg))
            if size >= SENT:
                sent, size = set(), 0
            if not first.all():
                again = np.zeros(len(d), _ENTRY)
                again["rid"], again["key"], again["s"], again["m"] = rid[d], key[d], start, m
                proven.append(again[~first])
                waiting += len(proven[-1])
            yield rows(VERIFY, *(x[first] for x in (d, span, place, t)), list(compress(seg, first)))
        for k in np.flatnonzero(e["kind"] == WINDOWS).tolist():
            text, s, m = texts[doc[k]], int(e["s"][k]), int(e["m"][k])
            digests = b"".join(hashlib.blake2b(text[i : i + width], digest_size=16).digest() for i in range(s, s + m))
            two = np.frombuffer(digests, "<u8").reshape(-1, 2)
            packer.add(_entries(two[:, 0], two[:, 1], rid[doc[k]], key[doc[k]], np.arange(s, s + m), np.ones(m, np.int64)))
        if packer.size + waiting >= FLUSH:
            yield from windows()
            waiting = 0
    yield from windows()


def shard_marks(pieces: list[tuple], width: int) -> np.ndarray:
    """Entries for the windows of segments (rid, key, s, bytes) that an earlier window of them equals."""
    text = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    order = suffix_array(text, 256)
    plcp = permuted_lcp(text, order)
    inside = np.repeat(starts + sizes - width, sizes) >= np.arange(len(text))  # a whole window starts here
    group = np.cumsum(plcp[order] < width)
    keep = inside[order]
    at, group = order[keep], group[keep]
    piece = np.searchsorted(starts, at, side="right") - 1
    e = np.empty(len(at), _ENTRY)
    e["a"], e["b"], e["m"], e["t"] = group, 0, 1, 0
    e["rid"], e["key"] = (np.array([p[i] for p in pieces], np.int64)[piece] for i in (0, 1))
    e["s"] = np.array([p[2] for p in pieces])[piece] + at - starts[piece]
    return _settle(e)[1]


class _Compared:
    """Compares copies with what they copy, which comes before them in a span."""

    def __init__(self) -> None:
        self.key, self.led, self.starts = None, [], []

    def add(self, keys: list[int], places: list[int], starts: list[int], pieces: list[bytes]) -> None:
        """Pieces in the order of their spans; fails if one is no copy of its span."""
        for key, s, t, piece in zip(keys, places, starts, pieces, strict=True):
            if key != self.key:
                self.key, self.led, self.starts = key, [], []
            if s < 0:
                self.led.append((t, piece))
                continue
            if len(self.starts) != len(self.led):
                self.led.sort()
                self.starts = [x for x, _ in self.led]
            at = bisect_right(self.starts, t) - 1
            for first, whole in ([self.led[at]] if at >= 0 else []) + self.led:
                if first <= t and whole[t - first : t - first + len(piece)] == piece:
                    break
            else:
                raise ValueError("two segments of equal hash have different bytes")


def _shard_batches(batches: Iterable[pa.RecordBatch], width: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Pieces by kind and shard: segments meet in suffix arrays of whole anchors, packed windows in their bucket, copies and what they copy in turn."""
    pieces: list[tuple] = []
    held: list[bytes] = []
    compared = _Compared()
    size, last, last_bucket = 0, None, None
    for batch in batches:
        rest = int(np.count_nonzero(batch.column(1).to_numpy(zero_copy_only=False) < VERIFY))  # the others come last
        for number, kind, a, rid, key, s, _, seg in zip(*(c.to_pylist() for c in batch.slice(0, rest).columns), strict=True):
            if held and number != last_bucket:
                marked = _settle(np.concatenate([_unpack(x) for x in held]))[1]
                held = []
                yield _out(MARK, marked)
            if kind == MARK:
                yield _out(MARK, _unpack(seg))
            elif kind == WINDOWS:
                held.append(seg)
                last_bucket = number
            else:
                if size >= shard and a != last:
                    yield _out(MARK, shard_marks(pieces, width))
                    pieces, size = [], 0
                pieces.append((rid, key, s, seg))
                size += len(seg)
                last = a
        if rest < batch.num_rows:
            own = batch.slice(rest)
            compared.add(*(own.column(k).to_pylist() for k in (2, 5, 6, 7)))
            copies = np.flatnonzero(own.column(5).to_numpy(zero_copy_only=False) >= 0)
            marks = np.zeros(len(copies), _ENTRY)
            for c, k in (("rid", 3), ("key", 4), ("s", 5)):
                marks[c] = own.column(k).to_numpy(zero_copy_only=False)[copies]
            marks["m"] = pc.binary_length(own.column(7)).to_numpy(zero_copy_only=False)[copies] - (width - 1)
            yield _out(MARK, marks)
    if held:
        yield _out(MARK, _settle(np.concatenate([_unpack(x) for x in held]))[1])
    if pieces:
        yield _out(MARK, shard_marks(pieces, width))


def spans_of(size: int, s: np.ndarray, m: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the marked windows: first windows, and how many from each."""
    edge = np.bincount(s, minlength=size + 1) - np.bincount(s.astype(np.int64) + m + (width - 1), minlength=size + 1)
    covered = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(covered))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def _result_batches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in in_parts(batches):
        texts, lists = batch.column(1), batch.column(2)
        marked = pc.fill_null(pc.greater(pc.list_value_length(lists), 0), False)
        sizes = pc.binary_length(texts).cast(pa.int64())
        flat = lists.filter(marked).flatten()
        s, m = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.cumsum(pc.list_value_length(lists.filter(marked)).to_numpy(zero_copy_only=False))
        kept, spans = [], [[] for _ in range(batch.num_rows)]
        rows = np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist()
        for row, text, a, b in zip(rows, texts.filter(marked).to_pylist(), [0, *cuts.tolist()], cuts.tolist(), strict=False):
            gone = spans_of(len(text), s[a:b], m[a:b], width)
            at, parts = 0, []
            for x, y in gone:
                parts.append(text[at:x])
                at = y
            kept.append(b"".join([*parts, text[at:]]))
            spans[row] = [{"start": x, "end": y} for x, y in gone]
        whole = pc.replace_with_mask(texts, marked, pa.array(kept, texts.type)) if rows else texts
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, whole, pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])


def window_marks(spark: SparkSession, rows: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(rid, key, s, m): runs of windows of rows (rid, key, t) that also start earlier."""
    ship(spark)
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(lambda it: _anchor_batches(it, width, buckets, hot), _PACKED)
    packed = packed.repartition("bucket").sortWithinPartitions("bucket")
    entries = stage(spark, packed.mapInArrow(lambda it: _bucket_batches(it, hot), _ROWS), "suffix-entries", release=True)
    wanted = entries.groupBy("rid", "key").agg(F.collect_list(F.struct("kind", "a", "b", "s", "m", "t")).alias("entries"))
    once = rows.join(wanted.hint("merge"), ["rid", "key"]).select("rid", "key", "t", "entries")
    pieces = once.mapInArrow(lambda it: _fetch_batches(it, width, buckets), _PIECES)
    pieces = pieces.repartition("shard").sortWithinPartitions("kind", "shard", "a", "s")
    marks = stage(spark, pieces.mapInArrow(lambda it: _shard_batches(it, width, shard), _ROWS), "suffix-marks", release=True)
    drop(spark, entries)
    return marks.select("rid", "key", "s", "m")


def suffix_dedup(
    spark: SparkSession, docs: DataFrame, width: int = WIDTH, hot: int = HOT, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (binary), spans: array<struct<start,end>> of removed bytes."""
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(rid.alias("rid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), text_bytes(text_col).alias("t"))
    marks = window_marks(spark, rows, width, hot, shard)
    spans = marks.groupBy("rid", "key").agg(F.collect_list(F.struct("s", "m")).alias("marks"))
    spans = stage(spark, spans, "suffix-spans", release=True)
    drop(spark, marks)
    whole = rows.join(spans.hint("merge"), ["rid", "key"], "left").select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias("doc_id"), "t", "marks")
    return whole.mapInArrow(lambda it: _result_batches(it, width), "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
