"""The sort of rotations, move-to-front and the coding of zeros, both ways."""

from __future__ import annotations

import numpy as np

from .errors import Damaged

RUN_A, RUN_B = 0, 1
MOST_WEIGHT = 2 * 1024 * 1024


def rotation_ranks(text: bytes) -> np.ndarray:
    """The rank of each rotation among all, equal rotations sharing one: doubling the compared length each round."""
    rank = np.unique(np.frombuffer(text, np.uint8), return_inverse=True)[1].astype(np.int64)
    n, length = len(text), 1
    while length < n and rank.max() < n - 1:
        key = rank * n + np.roll(rank, -length)
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        length *= 2
    return rank


def burrows_wheeler(text: bytes) -> tuple[bytes, int]:
    """The last column of the sorted rotations, and the row of the text itself."""
    if not text:
        return b"", 0
    order = np.argsort(rotation_ranks(text), kind="stable")
    a = np.frombuffer(text, np.uint8)
    return a[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def least_rotation(text: bytes) -> int:
    """Where the least rotation starts; of equal ones the first."""
    return int(rotation_ranks(text).argmin()) if text else 0


def period(text: bytes) -> int:
    """The smallest divisor p of the length such that the text repeats its first p bytes."""
    n = len(text)
    ranks = rotation_ranks(text) if text else np.zeros(0, int)
    again = np.flatnonzero(ranks[1:] == ranks[0]) + 1 if n else ranks
    return int(again[0]) if len(again) else n


def inverse(column: bytes, origin: int) -> bytes:
    """The text whose sorted rotations have this last column; whole cycles at a time by doubling pointers."""
    n = len(column)
    if not n:
        return b""
    if origin >= n:
        raise Damaged("BadOriginPointer")
    a = np.frombuffer(column, np.uint8)
    link = np.argsort(a, kind="stable")
    path, jump = np.array([link[origin]]), link
    while len(path) < n:
        path = np.concatenate([path, jump[path]])
        if len(path) < n:
            jump = jump[jump]
    return a[path[:n]].tobytes()


def move_to_front(column: bytes) -> tuple[list[int], list[int]]:
    """Positions, and the bytes that occur."""
    used = sorted(set(column))
    recent, out = bytearray(used), []
    last = -1
    for b in column:
        if b == last:
            out.append(0)
            continue
        at = recent.index(b)
        out.append(at)
        if at:
            del recent[at]
            recent.insert(0, b)
        last = b
    return out, used


def front_to_bytes(positions: list[int], used: list[int]) -> bytes:
    recent, out = bytearray(used), bytearray()
    for at in positions:
        b = recent[at]
        if at:
            del recent[at]
            recent.insert(0, b)
        out.append(b)
    return bytes(out)


def zero_digits(run: int) -> list[int]:
    """A run of zeros in bijective base 2, least digit first: the binary digits of run + 1 without the leading one, reversed."""
    return [int(d) for d in reversed(bin(run + 1)[3:])]


def code_zeros(positions: list[int], used: int) -> list[int]:
    """The symbols of a block, with its end."""
    out, run = [], 0
    for p in positions:
        if p == 0:
            run += 1
            continue
        if run:
            out += zero_digits(run)
            run = 0
        out.append(p + 1)
    if run:
        out += zero_digits(run)
    return [*out, used + 1]


def expand_zeros(symbols: list[int], most: int | None = None) -> list[int]:
    """Positions of a block's symbols, without the end; at most `most` of them."""
    out, run, weight = [], 0, 1
    for s in symbols:
        if s <= RUN_B:
            if weight > MOST_WEIGHT:
                raise Damaged("RunTooLong")
            run += weight << s
            weight <<= 1
            continue
        if run:
            if most is not None and len(out) + run > most:
                raise Damaged("BlockTooLarge")
            out += [0] * run
            run, weight = 0, 1
        out.append(s - 1)
        if most is not None and len(out) > most:
            raise Damaged("BlockTooLarge")
    if most is not None and len(out) + run > most:
        raise Damaged("BlockTooLarge")
    return out + [0] * run
