"""Words of many texts at once, as 64-bit hashes, in numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that words are made of: all but six blanks; or ASCII letters and digits and all of other scripts.
UNBLANK = np.ones(256, bool)
UNBLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins (with one more entry for the end); null is empty."""
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts in order, and where each text's words begin (and the end)."""
    raw, at = text_buffer(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = letters[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    words = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), words
    power, inverse = _power(len(raw))
    table = np.where(letters[_LOWER], _BYTE, _U(0))[_LOWER]
    values = table[raw]
    values *= power
    return mix(np.add.reduceat(values, starts) * inverse[starts]), words


_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text; of all words as one where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    h = words[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        h = h + words[i : n - k + 1 + i] * _STEP[i]
    return mix(h + _U(k))
