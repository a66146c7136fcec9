"""Texts as flat byte arrays: words, word hashes and blocks of bounded size, with numpy.

An Arrow string column already holds all its texts in one buffer. The functions
here work on that buffer as a whole, so no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK = 1 << 18


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive rows of about ``size`` bytes. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end - at, flat[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    if size not in _POWERS:
        made = []
        for r in (_R, _R_INV):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if size > 1 << 20:
            return tuple(made)
        _POWERS[size] = tuple(made)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first word of each text (one more at the end)."""
    ink = ~_SPACE[data]
    left = np.empty_like(ink)
    left[:1], left[1:] = True, ~ink[:-1]
    right = np.empty_like(ink)
    right[-1:], right[:-1] = True, ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    left[edge], right[edge - 1] = True, True
    starts, ends = np.flatnonzero(ink & left), np.flatnonzero(ink & right) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text (one more at the end)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows may be empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
