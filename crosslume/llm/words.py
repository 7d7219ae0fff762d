"""Words, their hashes and other arrays over the texts of an Arrow batch.

All functions work on the UTF-8 bytes of a slice of a batch at once, so that a task needs memory for
one slice (``SLICE_BYTES`` of text, or one longer document), whatever its partition holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Bytes of words without white space, and of words of letters, digits and non-ASCII text.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of a run of documents: places in ``data``, and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    width = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give free memory back to the system: workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that numpy allocates from
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose texts have ``limit`` bytes, or that are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
        release()


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; none reaches over documents."""
    mask = inside[data]
    full = offsets[1:] > offsets[:-1]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    heads = offsets[:-1][full]
    begin[heads] = mask[heads]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    tails = offsets[1:][full] - 1
    end[tails] = mask[tails]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n += n // 8  # the next slice may be a little longer
        _powers[:] = [np.full(n, base, np.uint64) for base in (_BASE, _INVERSE)]
        for table in _powers:
            table[0] = 1
            np.cumprod(table, out=table)
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, equal for equal spans."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(_BYTE[words.data], words.starts, words.ends)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on (the last ``n - 1`` words begin none)."""
    size = max(0, len(hashes) - n + 1)
    grams = np.zeros(size, np.uint64)
    for i in range(n):
        grams = grams * np.uint64(_BASE) + hashes[i : i + size]
    return mix(grams)


def strings(column: np.ndarray) -> pa.Array:
    return pa.array(column, pa.string())
