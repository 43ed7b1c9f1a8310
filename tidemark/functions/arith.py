"""Integer arithmetic coding with a 32-bit state (Witten, Neal and Cleary, 1987).

A model is a cumulative table c with c[0] = 0: symbol s owns c[s] to c[s + 1] of c[-1]. The
stream ends with a single 1 bit; a decoder reads zeros past the end. The number of symbols
is not in the stream.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache

from tidemark.functions.bits import BitReader, BitWriter

HALF, QUARTER = 1 << 31, 1 << 30
#: The largest total at which every symbol keeps a share of any reachable interval.
MAX_TOTAL = QUARTER + 2


def check_table(cumulative: Sequence[int]) -> None:
    if cumulative[-1] > MAX_TOTAL or any(b <= a for a, b in zip(cumulative, cumulative[1:], strict=False)):
        raise ValueError("cumulative table must grow and end at 2^30 + 2 at most")


class _Interval:
    """The state that coder and decoder share: narrowed by a symbol, then doubled while a bit is settled."""

    def __init__(self) -> None:
        self.low, self.high = 0, 2 * HALF - 1

    def narrow(self, begin: int, end: int, total: int) -> None:
        span = self.high - self.low + 1
        self.low, self.high = self.low + span * begin // total, self.low + span * end // total - 1
        while True:
            if self.high < HALF:
                self.settle(0)
            elif self.low >= HALF:
                self.settle(1)
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.settle(None)
            else:
                return

    def settle(self, bit: int | None) -> None:
        """Drops a bit both ends agree on, or (None) a middle half that leaves it open."""
        drop = QUARTER if bit is None else bit * HALF
        self.low, self.high = 2 * (self.low - drop), 2 * (self.high - drop) + 1


class Encoder(_Interval):
    def __init__(self) -> None:
        super().__init__()
        self.out, self.open = BitWriter(), 0

    def write(self, cumulative: Sequence[int], symbol: int) -> None:
        self.narrow(cumulative[symbol], cumulative[symbol + 1], cumulative[-1])

    def settle(self, bit: int | None) -> None:
        if bit is None:
            self.open += 1
        else:
            self.out.put(bit, 1)
            for _ in range(self.open):
                self.out.put(1 - bit, 1)
            self.open = 0
        super().settle(bit)

    def finish(self) -> bytes:
        self.out.put(1, 1)
        return self.out.to_bytes()


class Decoder(_Interval):
    def __init__(self, data: bytes) -> None:
        super().__init__()
        self.source = BitReader(data)
        self.code = self.source.get(32)

    def read(self, cumulative: Sequence[int]) -> int:
        span, total = self.high - self.low + 1, cumulative[-1]
        symbol = bisect_right(cumulative, ((self.code - self.low + 1) * total - 1) // span) - 1
        self.narrow(cumulative[symbol], cumulative[symbol + 1], total)
        return symbol

    def settle(self, bit: int | None) -> None:
        drop = QUARTER if bit is None else bit * HALF
        self.code = 2 * (self.code - drop) + self.source.bit()
        super().settle(bit)


def encode(symbols: Sequence[int], cumulative: Sequence[int]) -> bytes:
    check_table(cumulative)
    coder = Encoder()
    for s in symbols:
        coder.write(cumulative, s)
    return coder.finish()


def decode(data: bytes, cumulative: Sequence[int], count: int) -> list[int]:
    decoder = Decoder(data)
    return [decoder.read(cumulative) for _ in range(count)]


def smoothed(counts: Sequence[int]) -> list[int]:
    """Cumulative table of counts, each one higher."""
    table = [0]
    for c in counts:
        table.append(table[-1] + c + 1)
    return table


SCALE = 10_000_000


def quantised(probabilities: Sequence[float]) -> list[int]:
    """Cumulative table of probabilities at a scale of 10^7, each symbol one higher; cut to integers after the sum."""
    table, total = [0], 0.0
    for p in probabilities:
        total += p * SCALE + 1
        table.append(int(total))
    return table


@lru_cache(maxsize=64)
def uniform(size: int) -> list[int]:
    """The table of ``size`` equal symbols, shared by all who ask: not to be changed."""
    return quantised([1.0 / size] * size)
