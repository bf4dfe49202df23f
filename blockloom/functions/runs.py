"""Run-length coding before the sort: runs of 4 to 255 equal bytes become four copies and a count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LONGEST = 255
RESERVE = 19


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run, longer ones cut after 255 bytes."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(a)))
    parts = -(-lengths // LONGEST)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    order = np.arange(parts.sum()) - first
    cut = np.minimum(np.repeat(lengths, parts) - order * LONGEST, LONGEST)
    return np.repeat(starts, parts) + order * LONGEST, cut


def coded_lengths(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths >= 4, 5, lengths)


def encode(data: bytes) -> bytes:
    starts, lengths = pieces(data)
    if not len(starts):
        return b""
    values = np.frombuffer(data, np.uint8)[starts]
    size = coded_lengths(lengths)
    out = np.repeat(values, size)
    ends = np.cumsum(size) - 1
    long = lengths >= 4
    out[ends[long]] = (lengths[long] - 4).astype(np.uint8)
    return out.tobytes()


def coded_length(data: bytes) -> int:
    """The length of `encode`'s result."""
    a = np.frombuffer(data, np.uint8)
    lengths = np.diff(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))) if len(a) else a
    long = lengths[lengths >= 4]
    rest = long % LONGEST
    return int(len(a) - long.sum() + (long // LONGEST * 5 + np.where(rest >= 4, 5, rest)).sum())


def decode(coded: bytes) -> bytes:
    """Counts of up to 255 are accepted. The bytes after four equal ones are counts, which start no run themselves."""
    out, at, n = bytearray(), 0, len(coded)
    a = np.frombuffer(coded, np.uint8)
    same = (a[3:] == a[:-3]) & (a[2:-1] == a[:-3]) & (a[1:-2] == a[:-3]) if n >= 4 else np.zeros(0, bool)
    for start in np.flatnonzero(same).tolist():
        if start < at:
            continue
        out += coded[at : start + 4]
        at = start + 4
        if at < n:
            out += coded[start : start + 1] * coded[at]
            at += 1
    return bytes(out + coded[at:])


def block_limit(level: int) -> int:
    return level * 100_000 - RESERVE


def cuts(data: bytes, level: int, block_bytes: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Start and end of each block in data, and its coded length: as many whole runs as fit."""
    limit = block_limit(level)
    if block_bytes is not None:
        limit = max(min(block_bytes, limit), min(limit, 99_981))
    starts, lengths = pieces(data)
    ends, total = starts + lengths, np.cumsum(coded_lengths(lengths))
    first, before = 0, 0
    while first < len(starts):
        last = int(np.searchsorted(total, before + limit, side="right"))
        yield int(starts[first]), int(ends[last - 1]), int(total[last - 1] - before)
        first, before = last, int(total[last - 1])


def safe_chunk(level: int) -> int:
    """So many raw bytes always make one block: at worst, four equal bytes become five."""
    return block_limit(level) * 4 // 5
