"""Texts as subword token ids and back, by a plug-in tokenizer that each task makes once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

from pyspark.sql import DataFrame

from tidemark.operators.codec import by_row


class Tokenizer(Protocol):
    size: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...


class LibraryTokenizer:
    """A vocabulary file of the tokenizers library; strings of special tokens in a text become their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids), skip_special_tokens=False)


@lru_cache(maxsize=4)
def library(path: str) -> LibraryTokenizer:
    """One per task and file."""
    return LibraryTokenizer(path)


def tokenise(texts: DataFrame, factory: Callable[[], Tokenizer], key: str = "series_id", text: str = "text") -> DataFrame:
    """(key, ids) of texts that are not null."""
    return by_row(texts.where(texts[text].isNotNull()), [key], [text], lambda t: (factory().encode(t),), "ids array<int>")


def detokenise(rows: DataFrame, factory: Callable[[], Tokenizer], key: str = "series_id", ids: str = "ids") -> DataFrame:
    """(key, text)."""
    return by_row(rows, [key], [ids], lambda x: (factory().decode(x),), "text string")
