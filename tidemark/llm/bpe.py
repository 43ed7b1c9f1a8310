"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

Method: a text is cut at special tokens and by the public pre-tokenizer pattern; inside a
piece, an automaton over all token byte strings reports the tokens that end at every
position. For each prefix exactly one of them can be the last token of the prefix's
encoding: the one that is compatible with the last token of the prefix before it. That token
is stored, and following the stored tokens back from the end gives the exact ids. Two tokens
are compatible if no merge across their boundary comes before the merges that built them.

Pieces and token pairs recur, so their results are kept in tables of a fixed size. A text
with characters outside SETTLED is cut by the library's own pre-tokenizer: there the Unicode
versions of the two pattern engines tell letters and digits apart differently.

Edge cases: null text counts as empty and has no ids; white space, control characters and
any length of text or piece are encoded whole; special token strings in a text become their
ids, as the tokenizers library does by default; null or repeated ids of documents pass
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, text_bytes

VOCABULARY = "byte_bpe_50k.json"
MEMO = 200_000
ROWS = 256
SETTLED = "\\x00-\u0527\u2010-\u2070\u2100-\u2bff\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001faff"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + k)] = b
    return table


class Memo(dict):
    """A table of about ``size`` recent entries: a full one becomes the older half, from which hits return."""

    def __init__(self, size: int, make: Callable):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = self.raw = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.ids = {b: i for i, b in self.token_bytes.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank = [-1] * (max(self.token_bytes) + 1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = rank
            self.rank[whole] = rank
            self.halves[whole] = (a, b)
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.unsettled = regex.compile(f"[^{SETTLED}]").search
        self.library_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memo = Memo(MEMO, lambda p: self._packed(p.encode("utf-8")))
        self.fits = Memo(MEMO, lambda ab: self.compatible(*ab))

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between tokens a and b alone."""
        rank, pairs, halves = self.rank, self.pairs, self.halves
        end_a = end_b = 1 << 60  # when the own tree of a and of b consumes it
        while True:
            joined = pairs.get((a, b))
            # of equal merges the leftmost goes first: one inside a's tree before this, this before one inside b's
            if joined is not None and joined < end_a and joined <= end_b:
                return False
            if rank[a] > rank[b]:
                end_a, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                end_b, b = rank[b], halves[b][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        tokens = [-1] * (len(piece) + 1)  # the last token of each prefix, and where it starts
        starts = [0] * (len(piece) + 1)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if tokens[end + 1] < 0:
                start = end + 1 - size
                if not start or fits[tokens[start], token]:
                    tokens[end + 1] = token
                    starts[end + 1] = start
        ids, at = [], len(piece)
        while at:
            ids.append(tokens[at])
            at = starts[at]
        ids.reverse()
        return ids

    def _packed(self, piece: bytes) -> bytes:
        return np.array(self.encode_piece(piece), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if self.unsettled(text):
            return b"".join([self._packed(self.raw(p)) for p, _ in self.library_split(text)])
        pieces = self.split(text)
        if len(text) > 64 * len(pieces):  # long pieces don't recur and aren't kept
            return b"".join([self._packed(p.encode("utf-8")) if len(p) > 64 else self.memo[p] for p in pieces])
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str, special: bool = True) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; without ``special``, strings of special tokens are plain text."""
        if not special or self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.cut(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; invalid sequences become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def in_parts(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a step makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _mapped(path: str, of: Callable[[Bpe, list[bytes]], list[list]], types: list[pa.DataType], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in in_parts(batches):
            made = of(bpe, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(made, types, strict=True))], names=names)

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: binary, little-endian unsigned 32-bit."""
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    of = lambda bpe, texts: [[bpe.encode(as_text(t)) for t in texts]]
    return rows.mapInArrow(_mapped(path or vocabulary_path(VOCABULARY), of, [pa.binary()], ["doc_id", "ids"]), "doc_id long, ids binary")


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text (UTF-8 binary) of rows (doc_id, ids)."""
    ship(spark)
    of = lambda bpe, ids: [ids, [bpe.decode(x) for x in ids]]
    mapped = _mapped(path or vocabulary_path(VOCABULARY), of, [pa.binary(), pa.binary()], ["doc_id", "ids", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(mapped, "doc_id long, ids binary, text binary")
