"""The 13-symbol alphabet of numeric text, and dense indices of any alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: token ids of the symbols in two public vocabularies
SYMBOLS = "0123456789,-."
GPT2_IDS = (657, 352, 362, 513, 604, 642, 718, 767, 807, 860, 837, 532, 764)
LLAMA_IDS = (29900, 29896, 29906, 29941, 29946, 29945, 29953, 29955, 29947, 29929, 1919, 6653, 29889)


def symbol_ids(ids: tuple[int, ...] = GPT2_IDS) -> dict[str, int]:
    return dict(zip(SYMBOLS, ids, strict=True))


def dense_index(ids: tuple[int, ...] = GPT2_IDS) -> dict[str, int]:
    """Symbol to the rank of its id."""
    order = sorted(ids)
    return {c: order.index(i) for c, i in symbol_ids(ids).items()}


def lookup(symbol: Column, table: dict) -> Column:
    """A map literal; symbols outside it fail the query."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(F.map_contains_key(literal, symbol), F.element_at(literal, symbol)).otherwise(
        F.raise_error(F.concat(F.lit("symbol outside the alphabet: "), symbol)).cast("int")
    )


def dense_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, n, idx) of the distinct tokens, in their order; one row per token of the alphabet."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("idx", (F.row_number().over(Window.orderBy(token)) - 1).cast("int"))
