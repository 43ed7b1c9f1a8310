"""Bit strings over bytes, most significant bit first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BitWriter:
    def __init__(self) -> None:
        self.bits = bytearray()

    def put(self, value: int, width: int) -> None:
        for shift in range(width - 1, -1, -1):
            self.bits.append(value >> shift & 1)

    def to_bytes(self) -> bytes:
        """Zero-padded to whole bytes."""
        return np.packbits(np.frombuffer(bytes(self.bits), np.uint8)).tobytes() if self.bits else b""


class BitReader:
    """Reads past the end give zeros."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def get(self, width: int) -> int:
        value = 0
        for _ in range(width):
            value = value << 1 | self.bit()
        return value


def effective_bits(data: bytes) -> int:
    """Length in bits without trailing zero bits."""
    kept = data.rstrip(b"\0")
    if not kept:
        return 0
    last = kept[-1]
    return 8 * len(kept) - ((last & -last).bit_length() - 1)


def effective_bits_column(data: Column) -> Column:
    """The same as a column expression over binary."""
    digits = F.regexp_replace(F.hex(data), "0+$", "")
    last = F.right(digits, F.lit(1))
    open_bits = F.when(last.isin("2", "6", "A", "E"), 1).when(last.isin("4", "C"), 2).when(last == "8", 3).otherwise(0)
    return F.when(digits == "", F.lit(0)).otherwise(F.length(digits) * 4 - open_bits).cast("bigint")
