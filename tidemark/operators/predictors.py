"""Predictors: column expressions where the forecast is one, batches of contexts otherwise.

A plug-in is any object with ``predict(contexts: ndarray[n, L]) -> ndarray[n, S]``; a factory
makes it once per task. Pretrained models are such plug-ins and aren't part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions.rounding import half_even
from tidemark.operators.windows import padded, strided
from tidemark.shipping import ship


class Predictor(Protocol):
    def predict(self, contexts: np.ndarray) -> np.ndarray: ...


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("pos")


def naive(order: WindowSpec | None = None) -> Column:
    """The value before."""
    return F.lag("v", 1).over(order or by_series())


def linear(order: WindowSpec | None = None) -> Column:
    """The line through the two values before; needs both."""
    order = order or by_series()
    return 2 * F.lag("v", 1).over(order) - F.lag("v", 2).over(order)


def window_mean(length: int, order: WindowSpec | None = None) -> Column:
    """The mean of the ``length`` values before, rounded half to even; null while there are fewer. A stand-in for a model."""
    frame = (order or by_series()).rowsBetween(-length, -1)
    mean = F.rint(F.sum("v").over(frame) / F.lit(float(length))).cast("bigint")
    return F.when(F.count("v").over(frame) == length, mean)


class LastValue:
    """The naive predictor in plug-in form, repeated over the step."""

    def __init__(self, step: int = 1):
        self.step = step

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        return np.repeat(contexts[:, -1:], self.step, axis=1)


class WindowMean:
    def __init__(self, step: int = 1):
        self.step = step

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        return np.repeat(np.rint(contexts.mean(axis=1, keepdims=True)), self.step, axis=1)


def predict_windows(windows: DataFrame, factory: Callable[[], Predictor]) -> DataFrame:
    """Adds ``pred`` (array<double>) to rows (series_id, win, ctx, tgt), batch by batch.

    Only rows that reach this call pay for the model: filter first, a UDF inside CASE is
    evaluated for every row.
    """
    ship(windows.sparkSession)
    schema = StructType([*windows.schema.fields, StructField("pred", ArrayType(DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            if not b.num_rows:
                continue
            model = model or factory()
            contexts = np.array(b.column(b.schema.get_field_index("ctx")).to_pylist(), np.float64)
            made = pa.array(list(np.asarray(model.predict(contexts), np.float64)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "pred"])

    return windows.mapInArrow(run, schema)


def window_residuals(predicted: DataFrame, length: int, step: int, decimals: int | None = None) -> DataFrame:
    """(series_id, pos, residual): target less forecast, as integers, or as floats rounded half to even to ``decimals``."""
    pairs = F.posexplode(F.arrays_zip("tgt", "pred")).alias("k", "x")
    rows = predicted.select("series_id", "win", pairs)
    whole = F.col("x.tgt") - F.rint(F.col("x.pred")).cast("bigint")
    residual = whole if decimals is None else half_even(F.col("x.tgt") - F.col("x.pred"), decimals)
    return rows.select("series_id", (F.col("win") * step + length + F.col("k")).alias("pos"), residual.alias("residual"))


def model_forecasts(series: DataFrame, factory: Callable[[], Predictor], length: int, step: int) -> DataFrame:
    """(series_id, pos, forecast) of a plug-in for the points of whole windows, the last one filled up; forecasts are integers, half to even."""
    predicted = predict_windows(strided(padded(series, length, step), length, step), factory)
    rows = predicted.select("series_id", "win", F.posexplode("pred").alias("k", "x"))
    return rows.select("series_id", (F.col("win") * step + length + F.col("k")).alias("pos"), F.rint("x").cast("bigint").alias("forecast"))
