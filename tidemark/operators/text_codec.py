"""Coding of symbol sequences under a plug-in model: texts over an alphabet, and token ids of a vocabulary.

A head of symbols is coded uniformly; each further one under the probabilities that the model
gives it after the symbols before it. Decoder and coder make the same model from a factory
and the head, so the model itself is never stored. A text too long for one task is cut into
streams with heads of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arith
from tidemark.operators.codec import by_row
from tidemark.operators.windows import streams

TABLES = 1024


class TextModel(Protocol):
    """A plug-in: ``memory`` is how many symbols of a context tell its answer, or None if all do."""

    memory: int | None

    def probabilities(self, context: Sequence[int]) -> Sequence[float]:
        """The probability of each symbol after a context, which holds at most as many symbols as the head."""
        ...


#: Makes a model of so many symbols from a head that the decoder knows before anything else.
Factory = Callable[[int, Sequence[int]], TextModel]


class HeadModel:
    """An order-1 model with counts plus one, trained on the head."""

    memory = 1

    def __init__(self, size: int, head: Sequence[int]):
        self.size, self.counts = size, {}
        for a, b in zip(head, head[1:], strict=False):
            row = self.counts.setdefault(a, {})
            row[b] = row.get(b, 0) + 1

    def probabilities(self, context: Sequence[int]) -> list[float]:
        seen = self.counts.get(context[-1], {}) if context else {}
        total = sum(seen.values()) + self.size
        return [(seen.get(c, 0) + 1) / total for c in range(self.size)]


class FrequencyModel:
    """The same probabilities everywhere: counts plus one of a table that coder and decoder share."""

    memory = 0

    def __init__(self, size: int, counts: dict[int, int]):
        row = np.ones(size)
        for symbol, n in counts.items():
            row[symbol] += n
        self.row = row / row.sum()

    def probabilities(self, context: Sequence[int]) -> np.ndarray:
        return self.row


class SharedFrequencies:
    """A factory of one FrequencyModel for all texts of a task."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.made = counts, None

    def __call__(self, size: int, head: Sequence[int]) -> FrequencyModel:
        self.made = self.made or FrequencyModel(size, self.counts)
        return self.made

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "made": None}


class _Table:
    """Cumulative table of a context, and the ranks of its symbols by share, the largest first, ties to the smaller."""

    def __init__(self, probabilities: Sequence[float]):
        sums = np.cumsum(np.asarray(probabilities, np.float64) * arith.SCALE + 1).astype(np.int64)
        self.shares = np.diff(sums, prepend=0)
        self.cumulative = [0, *sums.tolist()]
        self.best = int(self.shares.argmax()) if len(self.shares) else 0
        self._order: list[int] | None = None
        self._ranks: list[int] | None = None

    @property
    def order(self) -> list[int]:
        if self._order is None:
            self._order = np.argsort(-self.shares, kind="stable").tolist()
        return self._order

    def rank(self, symbol: int) -> int:
        if self._ranks is None:
            self._ranks = np.argsort(self.order).tolist()
        return self._ranks[symbol]

    def share(self, symbol: int) -> float:
        return (self.cumulative[symbol + 1] - self.cumulative[symbol]) / self.cumulative[-1]


class _Source:
    """The tables of a model, of which those of recent contexts are kept."""

    def __init__(self, model: TextModel, window: int):
        self.model, self.window = model, max(window, 1)
        if not hasattr(model, "_tables"):
            model._tables = {}
        self.tables = model._tables

    def table(self, context: list[int]) -> _Table:
        memory = self.model.memory
        if memory is None:
            return _Table(self.model.probabilities(context[-self.window :]))
        key = context[-1] if memory == 1 and context else tuple(context[-memory:]) if memory else ()
        found = self.tables.get(key)
        if found is None:
            if len(self.tables) >= TABLES:
                self.tables.clear()
            found = self.tables[key] = _Table(self.model.probabilities(context[-self.window :]))
        return found

    def block(self, context: list[int], step: int) -> Iterator[_Table]:
        """Tables of the next ``step`` symbols: only the first follows the truth, the others the model's own best symbol."""
        if step == 1:
            yield self.table(context)
            return
        context = context[-self.window :]
        for k in range(step):
            table = self.table(context)
            yield table
            if k + 1 < step:
                context = [*context, table.best]


def encode_symbols(ids: Sequence[int], size: int, head: int, step: int, factory: Factory) -> tuple[bytes, list[int], list[float]]:
    """(payload, ranks, probabilities of the coded symbols)."""
    ids, ranks, probs = list(ids), [], []
    if not ids:
        return b"", ranks, probs
    coder, flat = arith.Encoder(), arith.uniform(size)
    for c in ids[:head]:
        coder.write(flat, c)
    source = _Source(factory(size, ids[:head]), head)
    for at in range(head, len(ids), step):
        for c, table in zip(ids[at : at + step], source.block(ids[max(0, at - source.window) : at], step), strict=False):
            coder.write(table.cumulative, c)
            ranks.append(table.rank(c))
            probs.append(table.share(c))
    return coder.finish(), ranks, probs


def decode_symbols(n: int, size: int, payload: bytes, head: int, step: int, factory: Factory, pick: Callable | None = None) -> list[int]:
    """The head from the payload, the rest symbol by symbol, from the payload too or from ``pick(table)``."""
    if not n:
        return []
    decoder, flat = arith.Decoder(payload), arith.uniform(size)
    out = [decoder.read(flat) for _ in range(min(head, n))]
    source = _Source(factory(size, out), head)
    while len(out) < n:
        for table in source.block(out[-source.window :], min(step, n - len(out))):
            out.append(pick(table) if pick else decoder.read(table.cumulative))
    return out


_MADE = "payload binary, ranks array<int>, probs array<double>"


def encode_text(
    texts: DataFrame, head: int = 256, alphabet: str | None = None, step: int = 1, key: str = "series_id", text: str = "text", factory: Factory = HeadModel
) -> DataFrame:
    """(key, n, symbols, payload, ranks, probs): a head coded uniformly, the rest under the model.

    ``symbols`` is the alphabet (that of the text itself by default). Ranks and probabilities
    of the coded symbols come with every row.
    """

    def one(t: str):
        letters = sorted(alphabet) if alphabet else sorted(set(t))
        index = {c: k for k, c in enumerate(letters)}
        return len(t), "".join(letters), *encode_symbols([index[c] for c in t], len(letters), head, step, factory)

    return by_row(texts, [key], [text], one, f"n bigint, symbols string, {_MADE}")


def decode_text(coded: DataFrame, head: int = 256, step: int = 1, key: str = "series_id", factory: Factory = HeadModel) -> DataFrame:
    """(key, text)."""

    def one(n: int, symbols: str, payload: bytes):
        return ("".join(symbols[k] for k in decode_symbols(n, len(symbols), payload, head, step, factory)),)

    return by_row(coded, [key], ["n", "symbols", "payload"], one, "text string")


def decode_ranks(coded: DataFrame, head: int = 256, step: int = 1, key: str = "series_id", factory: Factory = HeadModel) -> DataFrame:
    """(key, text) from the coded head and the ranks of the rest."""

    def one(n: int, symbols: str, payload: bytes, ranks: list[int]):
        left = iter(ranks)
        found = decode_symbols(n, len(symbols), payload, head, step, factory, lambda table: table.order[next(left)])
        return ("".join(symbols[k] for k in found),)

    return by_row(coded, [key], ["n", "symbols", "payload", "ranks"], one, "text string")


def encode_tokens(rows: DataFrame, size: int, factory: Factory, head: int = 256, step: int = 1, key: str = "series_id", ids: str = "ids") -> DataFrame:
    """(key, n, payload, ranks, probs) of arrays of token ids below ``size``."""

    def one(x: list[int]):
        return len(x), *encode_symbols(x, size, head, step, factory)

    return by_row(rows, [key], [ids], one, f"n bigint, {_MADE}")


def decode_tokens(coded: DataFrame, size: int, factory: Factory, head: int = 256, step: int = 1, key: str = "series_id") -> DataFrame:
    """(key, ids)."""
    return by_row(coded, [key], ["n", "payload"], lambda n, p: (decode_symbols(n, size, p, head, step, factory),), "ids array<int>")


# streams


def text_layout(n: Column, length: int, step: int, batch: int) -> dict[str, Column]:
    """Windows of a text of n symbols, and how ``windows.streams`` deals them; a text of no window is one final stream."""
    windows = F.greatest(F.lit(0), F.ceil((n - length) / step)).cast("bigint")
    dealt = streams(windows, batch)
    return {"windows": windows, "per_stream": dealt["per_stream"], "streams": F.when(dealt["per_stream"] > 0, dealt["streams"]).otherwise(0)}


def cut_text(texts: DataFrame, length: int, step: int, batch: int, fill: str, key: str = "series_id", text: str = "text") -> DataFrame:
    """Texts as streams: (key as a struct of key and stream_id, text).

    The text is filled up to whole windows with ``fill``, one symbol of the alphabet. Every
    stream but the final one stands for the windows dealt to it and begins with a raw head.
    """
    n = F.length(text)
    laid = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), *[c.cast("bigint").alias(k) for k, c in text_layout(n, length, step, batch).items()])
    filled = F.when(F.col("windows") > 0, F.rpad("t", (F.col("windows") * step + length).cast("int"), F.lit(fill))).otherwise(F.col("t"))
    span = F.col("per_stream") * step

    def cut(k: Column) -> Column:
        size = F.when(k < F.col("streams"), span).otherwise(F.col("windows") * step + length)
        return F.struct(k.alias("stream_id"), F.substring(F.col("filled"), (k * span + 1).cast("int"), size.cast("int")).alias("text"))

    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("streams")), cut)
    rows = laid.withColumn("filled", filled).select(key, F.inline(parts))
    return rows.select(F.struct(F.col(key), "stream_id").alias(key), "text")


def join_text(streams_: DataFrame, sizes: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, text) of decoded streams, without what filled the last window; ``sizes``: (key, n)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"{key}.stream_id").alias("k"), F.col("text").alias("t")))), lambda x: x["t"])
    whole = streams_.groupBy(F.col(f"{key}.{key}").alias(key)).agg(F.concat_ws("", ordered).alias("whole"))
    return whole.join(sizes, key).select(key, F.substring(F.col("whole"), F.lit(1), F.col("n").cast("int")).alias("text"))
