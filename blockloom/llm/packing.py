"""Packing by cutting-stock column generation.

Every document's tokens are cut into pieces of the full length and one rest. Rests are pieces of a histogram
with at most `SHORT` + `LENGTH / QUANTUM` classes, whatever the input's size: exact lengths up to `SHORT`, above that lengths rounded up
to multiples of `QUANTUM`. Of the pieces above `SHORT`, a linear program chooses how often each pattern
of classes fills a sequence; a knapsack dynamic program prices new patterns until none improves it. The
solution is rounded down, what is left over is packed best fit decreasing. Short pieces, longest first, fill the room that
patterns leave and then sequences of their own, to the token. The pieces of each class,
ranked over all tasks, take the places that the patterns offer.

The driver sees the histogram only. Ranks within a class come from counts by task, so no class, however
common its length, meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship
from ._bytes import lean
from ._shared import documents, written
from .tokens import default_vocabulary, fragments

LENGTH = 2048
QUANTUM = 8
SHORT = 128
END_ID = 1
GAP = 1e-3
MOST_STEPS = 8_000


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items of the given weights: value, and how many of each."""
    by_weight = np.full(capacity + 1, -1.0)
    by_weight[weights] = np.maximum(values, 0)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        gains = best[c - 1 :: -1][:c] + by_weight[1 : c + 1]
        k = int(gains.argmax())
        if gains[k] > best[c - 1]:
            best[c], took[c] = gains[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, int), capacity
    while c > 0:
        counts[took[c]] += took[c] > 0
        c -= max(1, took[c])
    return float(best[capacity]), counts[weights]


def column_generation(weights: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in a nearly optimal fractional solution."""
    n = len(weights)
    basis = [np.eye(n, dtype=int)[i] * (capacity // w) for i, w in enumerate(weights)]
    cost = np.ones(n)
    inverse = np.diag(1.0 / (capacity // weights))
    amount = inverse @ demand
    for _ in range(MOST_STEPS):
        prices = cost @ inverse
        value, pattern = knapsack(prices, weights, capacity)
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:  # a class is in oversupply: let it be
            column, its_cost, pattern = -np.eye(n)[worst], 0.0, -np.eye(n, dtype=int)[worst]
        elif value <= 1 + 1e-9 or cost @ amount * (1 - 1 / value) <= GAP * cost @ amount:
            break
        else:
            column, its_cost = pattern.astype(float), 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-11, amount / np.where(step > 1e-11, step, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        pivot = inverse[leaves] / step[leaves]
        moved = amount[leaves] / step[leaves]
        inverse -= np.outer(step, pivot)
        inverse[leaves] = pivot
        amount = np.maximum(amount - step * moved, 0)
        amount[leaves] = moved
        basis[leaves], cost[leaves] = pattern, its_cost
    return [(b, a) for b, a, c in zip(basis, amount.tolist(), cost, strict=True) if c and a > 0]


def best_fit(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Sequences for the pieces left over, longest first, each where the least room stays."""
    room: dict[int, list[dict[int, int]]] = {}
    for w in sorted(left, reverse=True):
        for _ in range(left[w]):
            fit = min((r for r in room if r >= w), default=None)
            if fit is None:
                fit, own = capacity, {}
            else:
                own = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            own[w] = own.get(w, 0) + 1
            room.setdefault(fit - w, []).append(own)
    return [s for own in room.values() for s in own]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """({class: pieces in a sequence}, sequences) that hold exactly or more than the histogram."""
    left = {w: n for w, n in histogram.items() if n}
    out = []
    if full := left.pop(capacity, 0):
        out.append(({capacity: 1}, full))
    if left:
        weights = np.array(sorted(left))
        demand = np.array([left[w] for w in weights], float)
        for counts, amount in sorted(column_generation(weights, demand, capacity), key=lambda x: -x[1]):
            own = {int(w): int(k) for w, k in zip(weights, counts, strict=True) if k}
            times = min([int(amount + 1e-6), *(left[w] // k for w, k in own.items())])
            if times > 0:
                out.append((own, times))
                for w, k in own.items():
                    left[w] -= times * k
    out += [(own, 1) for own in best_fit({w: n for w, n in left.items() if n}, capacity)]
    return out


def poured(plan: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """plan with the pieces left, by exact length, in the room of its sequences and in further sequences."""
    left = {w: n for w, n in left.items() if n}
    todo, out = plan[::-1], []
    while todo or left:
        own, times = todo.pop() if todo else ({}, max(left.values()))
        room, more = capacity - sum(w * k for w, k in own.items()), {}
        for w in sorted(left, reverse=True):
            if k := min(room // w, left[w]):
                more[w] = k
                room -= k * w
        now = min([times, *(left[w] // k for w, k in more.items())])
        out.append((own | more, now))
        for w, k in more.items():
            left[w] -= k * now
        left = {w: n for w, n in left.items() if n}
        if own and now < times:
            todo.append((own, times - now))
    return out


def planned(histogram: dict[int, int], length: int, quantum: int) -> list[tuple[dict[int, int], int]]:
    """As patterns, by classes in tokens: exact lengths up to SHORT, multiples of quantum above."""
    rounded = {w // quantum: n for w, n in histogram.items() if w > SHORT}
    plan = [({w * quantum: k for w, k in own.items()}, times) for own, times in patterns(rounded, length // quantum)]
    return poured(plan, {w: n for w, n in histogram.items() if w <= SHORT}, length)


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: where runs of ranks start, pieces in a sequence there, and the run's first sequence."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for own, times in plan:
        for w, k in own.items():
            found.setdefault(w, []).append((taken.get(w, 0), k, first))
            taken[w] = taken.get(w, 0) + k * times
        first += times
    return {w: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for w, runs in found.items()}


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, length: int, quantum: int) -> DataFrame:
    """A row for each piece, with the task that cut it and its rank among that task's pieces of its class."""

    def run(batches):
        known, task, ranks = fragments(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4")
        for batch in batches:
            rows = {k: [] for k in ("id", "start", "length", "crc", "tokens", "class", "rank")}
            for key, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column("__text")), strict=True):
                ids, n = np.append(ids, end), len(ids) + 1
                for start in range(0, n, length):
                    piece = ids[start : start + length]
                    held = len(piece)
                    kind = held if held <= SHORT else -(-held // quantum) * quantum
                    rank = ranks[kind] = ranks.get(kind, -1) + 1
                    for k, v in zip(rows, (key, start, held, zlib.crc32(piece), n, kind, rank), strict=True):
                        rows[k].append(v)
            arrays = [pa.array(v, batch.schema.field(0).type if k == "id" else pa.int64()) for k, v in rows.items()]
            arrays.append(pa.array([task] * len(rows["id"]), pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, [*rows, "task"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    return read.mapInArrow(lean(run), f"id {kind}, start bigint, length bigint, crc bigint, tokens bigint, class bigint, rank bigint, task bigint")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    quantum: int = QUANTUM,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Rows that repeat are packed each. An empty table gives an
    empty result. Other columns are ignored. `length` must be a multiple of `quantum`.
    """
    ship(docs.sparkSession)
    pieces = cut_pieces(docs, id_col, text_col, vocabulary or default_vocabulary(), length, quantum)
    pieces = written(pieces, "pack-pieces")
    held = pieces.groupBy("task", "class").agg(F.count("*").alias("held"))
    by_class = {r["class"]: r["n"] for r in held.groupBy("class").agg(F.sum("held").alias("n")).collect()}
    found = places(planned(by_class, length, quantum))

    before = held.withColumn("before", F.sum("held").over(W.partitionBy("class").orderBy("task")) - F.col("held")).drop("held")
    ranked = pieces.join(before, ["task", "class"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        for batch in batches:
            kinds, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("class", "rank"))
            sequence, at = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                rows = np.flatnonzero(kinds == kind)
                starts, per, first = found[int(kind)]
                run = np.searchsorted(starts, ranks[rows], side="right") - 1
                beyond = ranks[rows] - starts[run]
                sequence[rows], at[rows] = first[run] + beyond // per[run], beyond % per[run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("id", "start", "length", "crc", "tokens", "class")), pa.array(sequence), pa.array(at)],
                ["id", "start", "length", "crc", "tokens", "class", "sequence_id", "at"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(lean(place), f"id {kind}, start bigint, length bigint, crc bigint, tokens bigint, class bigint, sequence_id bigint, at bigint")
    inside = W.partitionBy("sequence_id").orderBy(F.desc("class"), "at")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (F.sum("length").over(inside) - F.col("length")).alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
