"""Code lengths, canonical codes and the choice of tables."""

from __future__ import annotations

import numpy as np

LONGEST = 17
CHUNK = 50


def code_lengths(frequencies: list[int], longest: int = LONGEST) -> list[int]:
    """Optimal lengths of at most `longest` bits by merging packages; symbols that never occur count once."""
    leaves = sorted((max(1, f), s) for s, f in enumerate(frequencies))
    if len(leaves) == 1:
        return [1]
    items = [(f, (s,)) for f, s in leaves]
    row = items
    for _ in range(longest - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = sorted(items + packages, key=lambda x: x[0])
    lengths = [0] * len(frequencies)
    for _, symbols in row[: 2 * len(leaves) - 2]:
        for s in symbols:
            lengths[s] += 1
    return lengths


def canonical_codes(lengths: list[int]) -> list[int]:
    """By length, then by symbol, each code is the one before plus one."""
    codes, code, last = [0] * len(lengths), 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= length - last
        codes[symbol] = code
        code, last = code + 1, length
    return codes


def table_count(symbols: int) -> int:
    return 2 + sum(symbols >= x for x in (200, 600, 1200, 2400))


def choose_tables(symbols: np.ndarray, alphabet: int, rounds: int = 4) -> tuple[list[list[int]], list[int]]:
    """Code lengths of each table, and the table of each chunk of 50 symbols.

    Tables start as parts of the alphabet with about equal use; then chunks take their cheapest table and tables follow
    their chunks, until nothing moves.
    """
    k = table_count(len(symbols))
    chunks = -(-len(symbols) // CHUNK)
    padded = np.full(chunks * CHUNK, -1)
    padded[: len(symbols)] = symbols
    padded = padded.reshape(chunks, CHUNK)
    use = np.zeros((chunks, alphabet), np.int64)
    rows = np.repeat(np.arange(chunks), CHUNK)
    np.add.at(use, (rows[padded.ravel() >= 0], padded.ravel()[padded.ravel() >= 0]), 1)
    share = np.cumsum(use.sum(0)) - use.sum(0) / 2
    part = np.minimum((share * k / len(symbols)).astype(int), k - 1)
    costs = np.where(part[None, :] == np.arange(k)[:, None], 1, 15)
    chosen = None
    for _ in range(rounds):
        best = (use @ costs.T).argmin(1)
        if chosen is not None and (best == chosen).all():
            break
        chosen = best
        costs = np.array([code_lengths(use[chosen == t].sum(0).tolist()) for t in range(k)])
    return costs.tolist(), chosen.tolist()
