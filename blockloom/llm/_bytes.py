"""Columns of texts as buffers of bytes, and their words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
AT_ONCE = 4_000_000


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each row starts and the last one ends; null texts are empty."""
    held = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The reverse of `flat`."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers)


def give_back() -> None:
    """Returns to the system what was freed; the C library and Arrow would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of a task `give_back`: workers wait for their next task beside those at work."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random number for each byte at each of 64 places.
PLACED = mixed(mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def row_groups(starts: np.ndarray, at_once: int = AT_ONCE):
    """(first row, row behind the last) of groups of about at_once bytes, one row at least."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + at_once, side="right")) - 1)
        yield row, stop
        row = stop


def word_hashes(data: np.ndarray, starts: np.ndarray, tail_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, runs of anything but ASCII white space with A-Z lowered, and how many words stand before each row.

    tail_bits: so many of the first bits are a hash of a word's last four bytes.
    """
    blank = BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    begins[1:][blank] = True
    kept = ~blank
    first = np.flatnonzero(begins[:-1] & kept)
    before = np.searchsorted(first, starts)
    if not len(first):
        return np.zeros(0, np.uint64), before
    low = LOWER[data[kept]].astype(np.int64)
    at = np.cumsum(kept)[first] - 1
    place = np.arange(len(low)) - np.repeat(at, np.diff(np.append(at, len(low))))
    value = PLACED[(place & 63) << 8 | low]
    far = np.flatnonzero(place >= 64)
    value[far] = mixed(mixed((place[far] << 8 | low[far]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    hashes = mixed(np.add.reduceat(value, at))
    if tail_bits:
        last, tail = np.append(at[1:], len(low)) - 1, np.zeros(len(at), np.int64)
        for back in range(4):
            tail = tail << 9 | np.where(last - back >= at, low[last - back] + 1, 0)
        shift = np.uint64(64 - tail_bits)
        hashes = mixed(mixed(tail.view(np.uint64) + np.uint64(1))) >> shift << shift | hashes >> np.uint64(tail_bits)
    return hashes, before
