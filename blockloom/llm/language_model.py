"""Language-model scoring with a log-bilinear model.

Tokens are words and one end for each text. Every training document is counted: how often each word occurs. The most frequent words and
the end are classes of their own; other words share a quarter of the classes by their last letters. The number of classes grows
with the number of training tokens (`class_bits`). The model gives a class after the two before it:
s(w | v1, v2) = q_w . (C1 r_v1 + C2 r_v2) + b_w, trained in numpy by noise-contrastive estimation: `NOISE` classes drawn from
the unigram distribution contrast with each batch of tokens. Every task trains on all tokens of its documents, and the parameters are averaged by
the tokens they come from; a first round on one document in `WARM_UP` gives all tasks the same start.

As s is a sum over the two places, batched matrix products of exp(q . C1 r_v1 + b) with exp(q . C2 r_v2) give the sums over all classes
for every pair (v1, v2), so every probability is normalised exactly. A word's probability within its class is its smoothed share of the class's counts,
with one place in each class for words that were never seen; so all probabilities sum to 1.

The most frequent words' counts, at most `LOOKED_UP`, go to every task. Rarer words of a document are looked up by a join
with the table of all counts, on 64-bit keys of words. The model is bounded in size; the table of counts grows with the corpus and never
leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._bytes import flat, row_groups, word_hashes
from ._shared import documents, dropped, written

LOOKED_UP = 1 << 18
SMOOTH = 0.1
WIDTH = 24
NOISE = 64
BATCH = 1_024
RATE = 0.05
WARM_UP = 16
#: A small corpus is read so often that about so many tokens are seen, PASSES times at most.
SEEN = 4_000_000
PASSES = 8
#: Parameters of tasks are summed in so many groups before the driver sees them.
GROUPS = 32
TOKENS_AT_ONCE = 4_000_000
#: The first bits of a word's key, which tell its class if it has none of its own.
TAIL_BITS = 9
#: Fixed value: the key of the end, which no word has.
END_KEY = 0


def class_bits(tokens: int) -> int:
    """Classes as a power of two: 256 for a small corpus, doubling with eight times the tokens, at most 2,048."""
    return int(np.clip(round(np.log2(max(tokens, 1)) / 3 + 2.5), 8, 11))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def keys_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words, as signed integers, and how many words stand before each row."""
    keys, before = word_hashes(data, starts, TAIL_BITS)
    return np.where(keys == END_KEY, np.uint64(1), keys).view(np.int64), before


def groups_of(batches, column: str = "__text"):
    """(batch, first row, row behind the last, keys, words before each row) of a few megabytes each."""
    for batch in batches:
        data, starts = flat(batch.column(column))
        for first, stop in row_groups(starts):
            yield batch, first, stop, *keys_of(data[starts[first] : starts[stop]], starts[first : stop + 1] - starts[first])


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """key, c: one row per distinct token of all training texts, the end with END_KEY."""

    def run(batches):
        held, size, ends = [], 0, 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys, END_KEY), pa.int64()), pa.array(np.append(n, ends), pa.int64())], ["key", "c"])

        for _, first, stop, keys, _ in groups_of(batches):
            held.append(keys)
            size, ends = size + len(keys), ends + stop - first
            if size > TOKENS_AT_ONCE:
                yield rows()
                held, size, ends = [], 0, 0
        if held:
            yield rows()

    read = training.select(F.col(text_col).alias("__text"))
    return read.mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")).where("c > 0")


class Classes:
    """The class of each word: its own if it is one of the most frequent, else by its last letters. `end` is the end's."""

    def __init__(self, own: np.ndarray, bits: int):
        """own: keys of the words with classes of their own, by class."""
        self.count, self.suffixes = 1 << bits, 1 << bits - 2
        self.end = self.count - self.suffixes - 1
        self.order = np.argsort(own)
        self.own = own[self.order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.end + 1 + (keys.view(np.uint64) >> np.uint64(64 - TAIL_BITS)).astype(np.int64) % self.suffixes
        if len(self.own):
            place = np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)
            out = np.where(self.own[place] == keys, self.order[place], out)
        return out

    def windows(self, keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's class and those of the one and the two before it, row by row; a text starts after two ends."""
        rows = len(before) - 1
        line = np.full(len(keys) + 2 * rows, self.end)
        line[np.arange(len(keys)) + 2 * np.repeat(np.arange(rows), np.diff(before)) + 1] = self.of(keys)
        target = np.ones(len(line), bool)
        target[before[:-1] + 2 * np.arange(rows)] = False
        at = np.flatnonzero(target)
        return line[at], line[at - 1], line[at - 2]  # before a text stands the end of another


@dataclass
class LogBilinear:
    context: np.ndarray  # r, by class
    target: np.ndarray  # q, by class
    first: np.ndarray  # C1
    second: np.ndarray  # C2
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.first, self.second, self.bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpacked(self, flat_: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for p in self.parts():
            out.append(flat_[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return LogBilinear(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, B, Z), natural logarithms: log P(w | v1, v2) = A[v1, w] + B[v2, w] - Z[v1, v2]."""
        a = (self.context.astype(np.float64) @ self.first.T) @ self.target.T + self.bias
        b = (self.context.astype(np.float64) @ self.second.T) @ self.target.T
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        return a, b, z


def beginning(unigram: np.ndarray, width: int = WIDTH) -> LogBilinear:
    rng, n = np.random.default_rng(7), len(unigram)
    vectors = [rng.normal(0, 0.1, (n, width)).astype(np.float32) for _ in range(2)]
    return LogBilinear(*vectors, np.eye(width, dtype=np.float32), 0.5 * np.eye(width, dtype=np.float32), np.log(unigram).astype(np.float32))


def row_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    held = at[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[held[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation by Adagrad, batch by batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int, noise: int = NOISE, rate: float = RATE):
        self.model, self.noise, self.rate = model, noise, rate
        self.offset = np.log(noise * unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full(p.shape, 1.0, np.float32) for p in model.parts()]

    def step(self, w: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> None:
        m, n = self.model, len(self.offset)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise) * self.cumulative[-1]), n - 1)
        hidden = (m.context @ m.first.T)[v1] + (m.context @ m.second.T)[v2]
        own, others = m.target[w], m.target[noise]
        chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        right = 1 - chance(np.einsum("ij,ij->i", hidden, own) + m.bias[w] - self.offset[w])
        wrong = -chance(hidden @ others.T + (m.bias - self.offset)[noise])
        d_hidden = right[:, None] * own + wrong @ others
        d_target = row_sums(w, right[:, None] * hidden, n)
        np.add.at(d_target, noise, wrong.T @ hidden)
        d_bias = np.bincount(w, right, n)
        np.add.at(d_bias, noise, wrong.sum(0))
        one, two = row_sums(v1, d_hidden, n), row_sums(v2, d_hidden, n)
        slopes = [one @ m.first + two @ m.second, d_target, one.T @ m.context, two.T @ m.context, d_bias.astype(np.float32)]
        for p, g, squares in zip(m.parts(), slopes, self.squares, strict=True):
            squares += g * g
            p += self.rate * g / np.sqrt(squares)

    def read(self, windows: tuple[np.ndarray, ...]) -> None:
        """Trains on all windows, in an order of its own."""
        order = self.rng.permutation(len(windows[0]))
        for at in range(0, len(order), BATCH):
            self.step(*(x[order[at : at + BATCH]] for x in windows))


def trained(training: DataFrame, shared, model: LogBilinear, passes: int) -> LogBilinear:
    """The mean of the models of all tasks that hold training texts, by their tokens."""
    start = training.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches):
        classes, unigram = shared.value
        task = TaskContext.get().partitionId()
        trainer, tokens = Trainer(model.unpacked(start.value.copy()), unigram, task), 0
        for _, _, _, keys, before in groups_of(batches):
            windows = classes.windows(keys, before)
            tokens += len(windows[0])
            for _ in range(passes):
                trainer.read(windows)
        if tokens:
            weighed = trainer.model.packed().astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([tokens], pa.int64()), pa.array([weighed.tobytes()], pa.binary())], ["task", "tokens", "sums"])

    def summed(batches):
        rows = sorted((r["task"], r["tokens"], r["sums"]) for b in batches for r in b.to_pylist())
        if rows:
            total = sum(np.frombuffer(s, np.float64) for _, _, s in rows)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([sum(n for _, n, _ in rows)], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "tokens", "sums"])

    kind = "task bigint, tokens bigint, sums binary"
    got = written(training.select("__text").mapInArrow(run, kind).repartition(GROUPS, "task").mapInArrow(summed, kind), "lm-models")
    rows = sorted((r["task"], r["tokens"], r["sums"]) for r in got.collect())
    dropped(got)
    if not rows:
        return model
    return model.unpacked(sum(np.frombuffer(s, np.float64) for _, _, s in rows) / sum(n for _, n, _ in rows))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of frequent words, at most `most`, the most frequent first: all from a count on that a histogram of counts gives."""
    level = F.floor(8 * F.log2("c")).cast("int")
    words = counts.where(F.col("key") != END_KEY)
    heights = {r["level"]: r["held"] for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("held")).collect()}
    least, room = 0, most
    for h in sorted(heights, reverse=True):
        room -= heights[h]
        if room < 0:
            least = h + 1
            break
    got = words.where(level >= least).toArrow()
    keys, c = (np.asarray(got[k].to_numpy()) for k in ("key", "c"))
    order = np.lexsort((keys, -c))
    return keys[order], c[order]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model learns from the rows that are not held out (by default: crc32 of the id as text mod 10 is not 0; null ids
    are not held out). Null texts count as empty: one token, the end. Rows that repeat are all counted and all scored. If
    nothing could be learnt, both scores are 0. Texts are read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = held_out(id_col) if held is None else held
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), held.alias("held"))
    training = read.where(~F.col("held"))
    counts = written(word_counts(training, "__text"), "lm-counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = whole["n"], whole["v"]
    keys, c = most_frequent(counts, LOOKED_UP)
    end_count = sum(r["c"] for r in counts.where(F.col("key") == END_KEY).collect())

    bits = class_bits(n)
    classes = Classes(keys[: (1 << bits) - (1 << bits - 2) - 1], bits)
    own = [int(k) for k in classes.own]
    by_letters = F.pmod(F.shiftrightunsigned("key", 64 - TAIL_BITS), F.lit(classes.suffixes)).cast("int")
    others = counts.where(F.col("key") != END_KEY).where(~F.col("key").isin(own)) if own else counts.where(F.col("key") != END_KEY)
    mass, places = np.zeros(classes.count), np.ones(classes.count)
    for r in others.groupBy(by_letters.alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[classes.end + 1 + r["class"]], places[classes.end + 1 + r["class"]] = r["c"], r["v"] + 1
    share = np.log10(mass + SMOOTH * places)
    mass[: len(own)], mass[classes.end] = c[: len(own)], end_count
    unigram = (mass + 0.5) / (mass + 0.5).sum()
    shared = spark.sparkContext.broadcast((classes, unigram))
    model = beginning(unigram)
    if n:
        passes = int(np.clip(SEEN // n, 1, PASSES))
        some = F.pmod(F.xxhash64("__text"), F.lit(WARM_UP)) == 0
        model = trained(training, shared, trained(training.where(some), shared, model, passes), passes)
    after_one, after_two, sums = (x.astype(np.float32) for x in (t / np.log(10) for t in model.tables()))
    by_key = np.argsort(keys)
    scored = spark.sparkContext.broadcast((after_one, after_two, sums, share, keys[by_key], c[by_key].astype(float)))
    denominator = float(np.log10(n + SMOOTH * (v + 1))) if n else 0.0

    def run(batches):
        (known, _), (one, two, z, class_size, held_keys, held_counts) = shared.value, scored.value
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch, first, stop, own_keys, before in groups_of(batches):
            rows, tokens = stop - first, np.diff(before) + 1
            w, v1, v2 = known.windows(own_keys, before)
            logs = one[v1, w].astype(np.float64) + two[v2, w] - z[v1, v2]
            begins = before[:-1] + np.arange(rows)
            score = np.add.reduceat(logs, begins)
            values = np.full(len(own_keys), np.nan)
            if len(held_keys):
                place = np.minimum(np.searchsorted(held_keys, own_keys), len(held_keys) - 1)
                values = np.where(held_keys[place] == own_keys, held_counts[place], np.nan)
            seen = ~np.isnan(values)
            logs = np.where(seen, np.log10(np.where(seen, values, 0) + SMOOTH), 0.0)
            owner = np.repeat(np.arange(rows), tokens - 1)
            of_class = known.of(own_keys)
            inside = np.where(of_class > known.end, logs - class_size[of_class], 0.0)
            score += np.bincount(owner, inside, rows)
            base = np.bincount(owner, logs, rows) + np.log10(end_count + SMOOTH) - tokens * denominator
            found = np.bincount(owner, seen, rows).astype(np.int64) + (end_count > 0)
            rare = np.flatnonzero(~seen)
            order = np.lexsort((own_keys[rare], owner[rare]))
            rare = rare[order]
            fresh = np.append(True, (own_keys[rare][1:] != own_keys[rare][:-1]) | (owner[rare][1:] != owner[rare][:-1])) if len(rare) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            offsets = pa.array(np.searchsorted(owner[rare[at]], np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (own_keys[rare[at]], np.diff(np.append(at, len(rare))))]
            part = batch.slice(first, rows)
            columns = [pa.array(np.arange(rows) + task + row), pa.array(tokens), pa.array(found), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), *columns, *lists], ["id", "held", "row", "n", "known", "base", "score", "rare", "times"])
            row += rows

    parts = read.mapInArrow(
        run, f"id {kind}, held boolean, row bigint, n bigint, known bigint, base double, score double, rare array<bigint>, times array<bigint>"
    )
    parts = written(parts, "lm-scores")
    rare = parts.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    times = F.coalesce(F.col("c"), F.lit(0))
    looked = rare.join(counts, "key", "left").groupBy("row")
    looked = looked.agg(
        F.sum(F.col("times") * F.log10(times + SMOOTH)).alias("more"), F.sum(F.when(times > 0, F.col("times")).otherwise(0)).alias("found")
    )
    total = parts.drop("rare", "times").join(written(looked, "lm-rare"), "row", "left")
    dropped(counts)
    more = F.coalesce("more", F.lit(0.0))
    return total.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known") if n else F.lit(0).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more if n else F.lit(0.0)).alias("base_score"),
        (F.col("score") + more if n else F.lit(0.0)).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
