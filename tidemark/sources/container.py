"""Containers: the streams of a series in one binary, each with its length in front, the final stream last."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import varint


def join_streams(payloads: list[bytes]) -> bytes:
    return b"".join(varint.encode(len(p)) + p for p in payloads)


def split_streams(data: bytes) -> list[bytes]:
    at, out = 0, []
    while at < len(data):
        size, at = varint.decode(data, at)
        out.append(data[at : at + size])
        at += size
    return out


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [join_streams(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["series_id", "container"])


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [split_streams(x) for x in b.column(1).to_pylist()]
        rows = pa.array([k for k, p in enumerate(parts) for _ in p], pa.int64())
        numbers = pa.array([n for p in parts for n in range(len(p))], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), numbers, pa.array([x for p in parts for x in p], pa.binary())], names=["series_id", "stream_id", "payload"])


def pack(streams: DataFrame) -> DataFrame:
    """(series_id, container) of rows (series_id, stream_id, payload)."""
    kind = streams.schema["series_id"].dataType.simpleString()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("stream_id", "payload"))), lambda x: x["payload"])
    return streams.groupBy("series_id").agg(ordered.alias("payloads")).mapInArrow(_pack, f"series_id {kind}, container binary")


def unpack(containers: DataFrame) -> DataFrame:
    """(series_id, stream_id, payload) of rows (series_id, container)."""
    kind = containers.schema["series_id"].dataType.simpleString()
    return containers.select("series_id", "container").mapInArrow(_split, f"series_id {kind}, stream_id int, payload binary")
