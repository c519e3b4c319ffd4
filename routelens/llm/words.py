"""Whole batches of texts as numpy arrays: UTF-8 parts, words and their hashes.

A word is a longest run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: ASCII letters and
digits and every non-ASCII character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

_LOWER = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _LOWER[_b] = _b
    elif 65 <= _b <= 90:
        _LOWER[_b] = _b + 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MUL
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def split_words(text: str | None) -> list[str]:
    """The words of one text."""
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows with about ``size`` bytes; a longer text is a run of its own.

    Null and empty texts are rows without bytes.
    """
    if pa.types.is_string_view(texts.type) or pa.types.is_dictionary(texts.type):
        texts = texts.cast(pa.large_string())
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    _, offset_buf, data_buf = texts.buffers()
    offsets = np.frombuffer(offset_buf, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Start, end, row and 64-bit hash of every word, in text order; then a hash of its first bytes for each of ``prefixes``."""
    n = len(data)
    none = tuple(np.zeros(0, np.uint64) for _ in range(len(prefixes) + 1))
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, *none
    low = _LOWER[data]
    inside = low != 0
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    first = inside & ~before
    start = np.flatnonzero(first)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return start, end, row, *none
    longest = int((end - start).max())
    within = np.arange(n, dtype=np.int64) - start[np.maximum(np.cumsum(first) - 1, 0)]
    np.clip(within, 0, longest - 1, out=within)
    value = low.astype(np.uint64) * powers(longest)[within]
    hashed = mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64))
    cut = [mix(np.add.reduceat(np.where(within < p, value, np.uint64(0)), start) + np.uint64(p << 32)) for p in prefixes]
    return start, end, row, hashed, *cut
