"""Vectorised words and hashes over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a null text has none. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20_240_601)
LETTERS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LETTERS[65:91] = LETTERS[97:123]
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
STEP = U(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(4096, STEP, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and the n + 1 offsets of the rows in them."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(texts) + texts.offset + 1)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each row, and the n + 1 offsets of the rows in them."""
    data, at = utf8(texts)
    solid = SOLID[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = ~solid[:-1]
    first[at[:-1][at[:-1] < len(data)]] = True
    where = np.flatnonzero(solid)
    begin = np.flatnonzero(first[where])
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    length = np.diff(begin, append=len(where))
    place = np.arange(len(where)) - np.repeat(begin, length)
    longest = int(length.max())
    powers = _powers if longest <= len(_powers) else np.cumprod(np.full(longest, STEP, dtype=np.uint64))
    hashes = mix(np.add.reduceat(LETTERS[data[where]] * powers[place], begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(where[begin], at)


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each row, sorted, and their offsets; of fewer words the whole sequence is one."""
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams * STEP + words[k : len(words) - n + 1 + k])
    else:
        grams = np.zeros(0, np.uint64)
    parts = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            parts.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            one = words[a].reshape(1) + U(int(b - a))
            for k in range(a + 1, b):
                one = mix(one * STEP + words[k])
            parts.append(one)
        else:
            parts.append(words[:0])
    return (np.concatenate(parts) if parts else words[:0]), np.cumsum([0, *map(len, parts)])
