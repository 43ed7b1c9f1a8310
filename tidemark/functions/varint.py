"""Bijective base-128 integers: little-endian groups of 7 bits, the high bit set on all but the last.

Each further byte stands for one less, so every number has exactly one code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(128 | n & 127)
        n = (n >> 7) - 1
    out.append(n)
    return bytes(out)


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, place after it)."""
    size = 1
    while data[at + size - 1] & 128:
        size += 1
    n = data[at + size - 1]
    for k in range(size - 2, -1, -1):
        n = (n + 1 << 7) + (data[at + k] & 127)
    return n, at + size


def length(n: Column) -> Column:
    """Bytes of the code of a number that is not negative."""
    limits, out = [], F.lit(9)
    top = 0
    for size in range(1, 9):
        top += 128**size
        limits.append((size, top))
    for size, limit in reversed(limits):
        out = F.when(n < F.lit(limit), F.lit(size)).otherwise(out)
    return out.cast("int")
