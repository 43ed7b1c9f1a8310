"""Coding and decoding of whole series, one row per series, in Arrow batches.

Rows are gathered into one array per series on the JVM side, so that a batch holds many short
series; a series too long for that is cut into streams first (``windows.stream_layout``, or a
stream number in the series id), each with a head of its own. Residuals, methods and
frequencies are columns; only the sequential coders run in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.functions import arith, xor
from tidemark.operators.predictors import Predictor
from tidemark.shipping import ship

METHODS = 3


def gathered(rows: DataFrame, *columns: str, key: str = "series_id") -> DataFrame:
    """One row per series: the key and an array of each column in the order of pos."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return rows.groupBy(key).agg(ordered.alias("rows")).select(key, *[F.col(f"rows.{c}").alias(c) for c in ("pos", *columns)])


def by_row(df: DataFrame, keep: list[str], args: list[str], function: Callable, made: str) -> DataFrame:
    """Columns ``keep`` and what ``function(*args)`` returns for each row, as the columns ``made``."""
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    ship(df.sparkSession)
    types = to_arrow_schema(_parse_datatype_string(made))
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            results = [function(*x) for x in zip(*(b.column(n + k).to_pylist() for k in range(len(args))), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*results, strict=True), types.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *columns], names=[*keep, *types.names])

    return df.select(*keep, *args).mapInArrow(run, f"{kept}, {made}")


def counts_of(symbols: list[int], size: int) -> list[int]:
    return np.bincount(np.array(symbols, np.int64), minlength=size).tolist() if symbols else [0] * size


def encode_methods(series: DataFrame, methods: int = METHODS) -> DataFrame:
    """(series_id, n, freqs, payload) of rows with a ``method`` array: arithmetic coding under counts plus one."""

    def one(symbols: list[int]):
        counts = counts_of(symbols, methods)
        return len(symbols), [c + 1 for c in counts], arith.encode(symbols, arith.smoothed(counts))

    return by_row(series, ["series_id"], ["method"], one, "n bigint, freqs array<bigint>, payload binary")


def decode_methods(coded: DataFrame) -> DataFrame:
    """(series_id, method array)."""

    def one(n: int, freqs: list[int], payload: bytes):
        return (arith.decode(payload, arith.smoothed([f - 1 for f in freqs]), n),)

    return by_row(coded, ["series_id"], ["n", "freqs", "payload"], one, "method array<int>")


def flat_words(column: pa.ChunkedArray | pa.Array, floats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a column of arrays, one after the other, and where each array begins; a null array is empty."""
    kind = np.float64 if floats else np.int64
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, kind).view(np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def by_batch(df: DataFrame, keep: list[str], args: list[str], function: Callable, made: str) -> DataFrame:
    """As ``by_row``, but ``function`` takes whole columns of a batch and returns whole columns."""
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    ship(df.sparkSession)
    types = to_arrow_schema(_parse_datatype_string(made))
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(function(*b.columns[n:]), types.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *columns], names=[*keep, *types.names])

    return df.select(*keep, *args).mapInArrow(run, f"{kept}, {made}")


def encode_words(series: DataFrame, column: str, floats: bool = False) -> DataFrame:
    """(series_id, n, payload, bit_len): XOR coding of an array of 64-bit integers or floats, a batch of series at once."""

    def all_of(values: pa.Array):
        words, offsets = flat_words(values, floats)
        payloads, bits = xor.encode_all(words, offsets)
        return np.diff(offsets), payloads, bits

    return by_batch(series, ["series_id"], [column], all_of, "n bigint, payload binary, bit_len bigint")


def decode_words(coded: DataFrame, floats: bool = False) -> DataFrame:
    """(series_id, value array)."""

    def all_of(n: pa.Array, payloads: pa.Array):
        counts = n.to_numpy(zero_copy_only=False)
        words = xor.decode_all(payloads.to_pylist(), counts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return (pa.ListArray.from_arrays(offsets, pa.array(words.view(np.float64 if floats else np.int64))),)

    return by_batch(coded, ["series_id"], ["n", "payload"], all_of, f"value array<{'double' if floats else 'bigint'}>")


def encode_hybrid(coded_rows: DataFrame, heads: DataFrame, methods: int = METHODS) -> DataFrame:
    """One container row per series: head, n, freqs, method_payload, residual_payload.

    ``coded_rows``: (series_id, pos, method, residual); ``heads``: (series_id, pos, v) before
    them. A series shorter than its head has no coded points and is stored raw.
    """

    def all_of(method: pa.Array, residual: pa.Array):
        chosen = [m or [] for m in method.to_pylist()]
        counts = [counts_of(m, methods) for m in chosen]
        packed = [arith.encode(m, arith.smoothed(c)) if m else b"" for m, c in zip(chosen, counts, strict=True)]
        return list(map(len, chosen)), [[f + 1 for f in c] for c in counts], packed, xor.encode_all(*flat_words(residual))[0]

    head = gathered(heads, "v").select("series_id", F.col("v").alias("head"))
    both = head.join(gathered(coded_rows, "method", "residual"), "series_id", "left")
    return by_batch(both, ["series_id", "head"], ["method", "residual"], all_of, "n bigint, freqs array<bigint>, method_payload binary, residual_payload binary")


def decode_hybrid(coded: DataFrame, mean_length: int = 16, factory: Callable[[], Predictor] | None = None, length: int = 16, step: int = 1) -> DataFrame:
    """(series_id, pos, v): each point from its method's forecast over the points decoded before it.

    With a plug-in the third tier is its forecast for the window of ``step`` points that a point lies in, from the
    ``length`` points before that window (``predictors.model_forecasts``).
    """

    def one(head: list[int], n: int, freqs: list[int], method_payload: bytes, residuals: list[int]):
        out, model, known = list(head), factory() if factory else None, {}

        def of_model() -> int:
            win, k = divmod(len(out) - length, step)
            if win not in known:
                known.clear()
                context = np.array([out[win * step : win * step + length]], np.float64)
                known[win] = np.rint(model.predict(context)[0]).astype(np.int64).tolist()
            return known[win][k]

        methods = arith.decode(method_payload, arith.smoothed([f - 1 for f in freqs]), n) if n else []
        for method, residual in zip(methods, residuals, strict=True):
            if method == 0:
                forecast = out[-1]
            elif method == 1:
                forecast = 2 * out[-1] - out[-2]
            elif model:
                forecast = of_model()
            else:
                forecast = round(sum(out[-mean_length:]) / mean_length)
            out.append(forecast + residual)
        return out

    def all_of(head: pa.Array, n: pa.Array, freqs: pa.Array, method_payload: pa.Array, residual_payload: pa.Array):
        counts = n.to_numpy(zero_copy_only=False)
        words = xor.decode_all(residual_payload.to_pylist(), counts).view(np.int64)
        residuals = [x.tolist() for x in np.split(words, np.cumsum(counts)[:-1])]
        return ([one(*x) for x in zip(head.to_pylist(), counts.tolist(), freqs.to_pylist(), method_payload.to_pylist(), residuals, strict=True)],)

    rows = by_batch(coded, ["series_id"], ["head", "n", "freqs", "method_payload", "residual_payload"], all_of, "value array<bigint>")
    return exploded(rows)


def decode_residuals(heads: DataFrame, residuals: DataFrame, factory: Callable[[], Predictor], length: int, step: int) -> DataFrame:
    """(series_id, pos, v) from raw heads (series_id, pos, v) and window residuals (series_id, pos, residual).

    Each window of ``step`` values is forecast from the ``length`` values decoded before it.
    """

    def one(head: list[int], residual: list[int] | None):
        model, out = factory(), list(head)
        residual = residual or []
        for at in range(0, len(residual), step):
            forecast = np.rint(model.predict(np.array([out[-length:]], np.float64))[0]).astype(np.int64).tolist()
            out += [f + r for f, r in zip(forecast, residual[at : at + step], strict=False)]
        return (out,)

    both = gathered(heads, "v").select("series_id", F.col("v").alias("head")).join(gathered(residuals, "residual"), "series_id", "left")
    return exploded(by_row(both, ["series_id"], ["head", "residual"], one, "value array<bigint>"))


def exploded(rows: DataFrame, column: str = "value", key: str = "series_id") -> DataFrame:
    values = rows.select(key, F.posexplode(column).alias("pos", "v"))
    return values.withColumn("pos", F.col("pos").cast("bigint"))


def xor_layout(residual: Column, before: Column) -> dict[str, Column]:
    """Leading and trailing zeros and significant bits of the XOR of neighbours, as column expressions."""
    x = residual.bitwiseXOR(before)
    digits = F.bin(x)
    leading = F.when(x == 0, 64).otherwise(64 - F.length(digits))
    trailing = F.when(x == 0, 0).otherwise(F.length(digits) - F.length(F.regexp_replace(digits, "0+$", "")))
    size = F.when(x == 0, 0).otherwise(64 - leading - trailing)
    return {"lz": leading.cast("int"), "tz": trailing.cast("int"), "sig": size.cast("int"), "bits": F.when(x == 0, 1).otherwise(13 + size).cast("int")}
