"""Numpy helpers over Arrow batches of texts, for use inside Spark's Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are held as arrays at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys64(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE_KEYS = keys64(256, 11)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and where each text starts, with the end last."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), in order; the first word of
    each text, with the end last; and each word's first byte in the texts joined."""
    data, at = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_text = at[:-1][at[:-1] < len(data)]
    first[starts_text] = inside[starts_text]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), starts
    letters = data[inside]
    begins = np.cumsum(inside)[starts] - 1
    lens = np.diff(np.append(begins, len(letters)))
    pos = np.arange(len(letters)) - np.repeat(begins, lens)
    power = np.ones(int(lens.max()), np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(power, dtype=np.uint64)
    h = np.add.reduceat(_BYTE_KEYS[letters] * power[pos], begins)
    return mix64(h ^ lens.astype(np.uint64)), np.searchsorted(starts, at), starts
