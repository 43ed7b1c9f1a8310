"""Rounding to fixed decimals, half to even, and scaled integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, decimals: int) -> Column:
    """Nearest multiple of 10^-decimals, ties to even (``round`` in Spark takes ties away from zero)."""
    p = float(10**decimals)
    return F.rint(x * p) / p


def scaled(x: Column, decimals: int) -> Column:
    """The value as an integer count of 10^-decimals."""
    return F.rint(x * float(10**decimals)).cast("bigint")


def truncated(x: Column) -> Column:
    """A forecast as an integer, cut towards zero."""
    return x.cast("bigint")


def rounded(x: Column) -> Column:
    """A forecast as an integer, half to even."""
    return F.rint(x).cast("bigint")
