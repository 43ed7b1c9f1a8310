"""XOR coding of 64-bit words: 8 raw bytes, then each word against the one before it.

An equal word is the bit 0. Another is 1, the leading zeros of the XOR (6 bits), the length
of its significant part less one (6 bits), and that part.

``encode_all`` and ``decode_all`` code many series at once in array operations; ``encode`` and
``decode`` are the same for one.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1


def words_of_ints(values) -> list[int]:
    return np.asarray(values, np.int64).view(np.uint64).tolist()


def words_of_floats(values) -> list[int]:
    return np.asarray(values, np.float64).view(np.uint64).tolist()


def ints_of_words(words: list[int]) -> np.ndarray:
    return np.array(words, np.uint64).view(np.int64)


def floats_of_words(words: list[int]) -> np.ndarray:
    return np.array(words, np.uint64).view(np.float64)


def encode(words: list[int]) -> tuple[bytes, int]:
    """Payload and its length in bits; no words give an empty payload."""
    if not words:
        return b"", 0
    bits = []
    for before, word in zip(words, words[1:], strict=False):
        x = before ^ word
        if not x:
            bits.append("0")
            continue
        zeros = (x & -x).bit_length() - 1
        size = x.bit_length() - zeros
        bits.append(f"1{64 - x.bit_length():06b}{size - 1:06b}{x >> zeros:0{size}b}")
    tail = "".join(bits)
    pad = -len(tail) % 8
    body = int(tail + "0" * pad, 2).to_bytes((len(tail) + pad) // 8, "big") if tail else b""
    return words[0].to_bytes(8, "little") + body, 64 + len(tail)


def decode(payload: bytes, count: int) -> list[int]:
    if not count:
        return []
    word, at = int.from_bytes(payload[:8], "little"), 0
    words, body = [word], payload[8:]
    # the whole string at once, and zeros past the end
    bits = f"{int.from_bytes(body, 'big'):0{8 * len(body)}b}" + "0" * (count + 78) if body else "0" * (count + 78)
    while len(words) < count:
        if bits[at] == "0":
            at += 1
        else:
            leading, size = int(bits[at + 1 : at + 7], 2), int(bits[at + 7 : at + 13], 2) + 1
            word ^= int(bits[at + 13 : at + 13 + size], 2) << (64 - leading - size)
            at += 13 + size
        words.append(word)
    return words


#: Words that are coded in one go, and series from which on decoding in step pays.
CHUNK, IN_STEP = 1 << 16, 128


def _smear(x: np.ndarray) -> np.ndarray:
    """All bits below the highest set bit set too."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return x


def encode_all(words: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Payload and bits of each series; series k is words[offsets[k]:offsets[k + 1]]."""
    payloads: list[bytes] = []
    sizes: list[int] = []
    first = 0
    while first + 1 < len(offsets):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        made = _encode_chunk(words[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        payloads += made[0]
        sizes += made[1]
        first = last
    return payloads, sizes


def _encode_chunk(words: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[int]]:
    words = words.astype(np.uint64)
    counts = np.diff(offsets)
    x = words.copy()
    x[1:] ^= words[:-1]
    head = np.zeros(len(words), bool)
    head[offsets[:-1][counts > 0]] = True
    trailing = np.bitwise_count(~x & (x - np.uint64(1))).astype(np.int64)
    top = np.bitwise_count(_smear(x)).astype(np.int64)  # 64 less the leading zeros
    changed = x != 0
    body = np.where(changed, top - trailing, 0)
    mark = np.where(changed, 1 << 12 | (64 - top) << 6 | (body - 1), 0).astype(np.uint64)
    # two fields a word: the mark, and the significant part; none for the first word of a series
    width = np.empty((len(words), 2), np.int64)
    width[:, 0] = np.where(head, 0, np.where(changed, 13, 1))
    width[:, 1] = np.where(head, 0, body)
    value = np.empty((len(words), 2), np.uint64)
    value[:, 0] = mark
    value[:, 1] = np.where(changed, x >> np.minimum(trailing, 63).astype(np.uint64), np.uint64(0))
    total = np.concatenate(([0], np.cumsum(width.sum(axis=1))))
    bits = total[offsets[1:]] - total[offsets[:-1]]
    size = -(-bits // 8)
    start = np.concatenate(([0], np.cumsum(size)))  # in bytes, each series from a byte of its own
    flat_width, flat_value = width.ravel(), value.ravel()
    ends = np.cumsum(flat_width)
    shift = np.repeat(ends, flat_width) - 1 - np.arange(ends[-1] if len(ends) else 0)
    out = np.zeros(8 * int(start[-1]), np.uint8)
    gap = np.repeat(8 * start[:-1] - total[offsets[:-1]], bits)
    out[np.arange(len(shift)) + gap] = (np.repeat(flat_value, flat_width) >> shift.astype(np.uint64)) & np.uint64(1)
    packed = np.packbits(out).tobytes()
    raw = words[np.minimum(offsets[:-1], max(len(words) - 1, 0))].astype("<u8") if len(words) else np.zeros(len(counts), "<u8")
    payloads = [r.tobytes() + packed[a:b] if n else b"" for r, a, b, n in zip(raw, start[:-1].tolist(), start[1:].tolist(), counts.tolist(), strict=True)]
    return payloads, np.where(counts > 0, bits + 64, 0).tolist()


def decode_all(payloads: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The words of all series, one after the other; many series are read in step, word by word."""
    counts = np.asarray(counts, np.int64)
    if len(payloads) < IN_STEP:
        return np.array([w for p, n in zip(payloads, counts.tolist(), strict=True) for w in decode(p, n)], np.uint64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(offsets[-1]), np.uint64)
    sizes = np.array([max(len(p) - 8, 0) for p in payloads], np.int64)
    bits = np.unpackbits(np.frombuffer(b"".join(p[8:] for p in payloads) + bytes(16), np.uint8))
    at = 8 * (np.cumsum(sizes) - sizes)
    stop = at + 8 * sizes
    word = np.array([int.from_bytes(p[:8], "little") for p in payloads], np.uint64)
    live = np.flatnonzero(counts > 0)
    out[offsets[live]] = word[live]
    weights = 1 << np.arange(5, -1, -1)
    for k in range(1, int(counts.max(initial=0))):
        live = live[counts[live] > k]
        here = at[live]
        changed = (bits[here] == 1) & (here < stop[live])  # past the end there are zeros
        at[live] += 1
        rows = live[changed]
        if len(rows):
            here = at[rows]
            fields = bits[here[:, None] + np.arange(12)]
            leading, size = fields[:, :6] @ weights, fields[:, 6:] @ weights + 1
            part = np.packbits(bits[np.minimum(here[:, None] + 12 + np.arange(64), len(bits) - 1)], axis=1).view(">u8").ravel().astype(np.uint64)
            part = (part >> (64 - size).astype(np.uint64)) << np.maximum(64 - leading - size, 0).astype(np.uint64)
            word[rows] ^= part
            at[rows] += 12 + size
        out[offsets[live] + k] = word[live]
    return out
