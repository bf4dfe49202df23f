"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(eta - t_k), with thresholds t_1 < t_2 < ... that all grades share and one linear predictor eta
from hashed text: the shapes of words (letters as a, capitals as A, digits as 0, runs as one), pairs of successive shapes, and
repeats of the word before. A run of more than `LONG` characters without white space counts as words of `PIECE` characters each,
so unspaced texts are judged on all they hold. eta is the mean weight over a text's words, drawn to 0 for very short texts.
The expected grade and the probability of reaching the target grade follow from eta by built-in expressions.

The model is fitted on a bounded sample of rated documents (`SAMPLE`, the smallest hashes of ids); every document is scored
on its whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship
from ._shared import documents, new_name

SAMPLE = 6_000
SLOTS = 1 << 13
TARGET = 1
KEEP_FROM = 0.5
DRAW = 4
REMEMBERED = 300_000
LONG = 64
PIECE = 16
RUNS = re.compile(r"(.)\1+")

_shapes: dict[str, int] = {}


def shape(word: str) -> int:
    """The slot of a word's shape: letters a or A, digits 0, other signs as they are, runs as one."""
    kinds = "".join(["a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
    return zlib.crc32(RUNS.sub(r"\1", kinds).encode("utf-8", "surrogatepass")) % SLOTS


def pieces(words: list[str]) -> list[str]:
    """The words; those of more than LONG characters cut into runs of PIECE, the last one shorter."""
    out = []
    for w in words:
        out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)] if len(w) > LONG else [w]
    return out


def slots(text: str) -> tuple[np.ndarray, int]:
    """Slots of all features of a text, and its number of words, long ones in pieces."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), 0
    known = _shapes
    if len(known) > REMEMBERED:
        known.clear()
    new = set(words).difference(known)
    if any(len(w) > LONG for w in new):  # long ones are never known
        words = pieces(words)
        new = set(words).difference(known)
    for w in new:
        known[w] = shape(w)
    own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pairs = SLOTS + (own[:-1] * 31 + own[1:]) % SLOTS
    repeats = sum(map(eq, words, words[1:]))
    return np.concatenate([own, pairs, np.full(repeats, 2 * SLOTS)]), len(words)


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades
    grades: list[int]

    def eta(self, text: str | None) -> float:
        at, n = slots(text or "")
        return float(self.weights[at].sum() / (n + DRAW))

    def reach(self, eta: Column, grade: int) -> Column:
        """P(grade or better)."""
        k = sum(g < grade for g in self.grades)
        if k == 0:
            return F.lit(1.0)
        if k >= len(self.grades):
            return F.lit(0.0)
        return 1 / (1 + F.exp(F.lit(float(self.thresholds[k - 1])) - eta))

    def expected(self, eta: Column) -> Column:
        out = F.lit(float(self.grades[0]))
        for low, high in zip(self.grades, self.grades[1:], strict=False):
            out = out + (high - low) * self.reach(eta, high)
        return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 300, rate: float = 0.3, decay: float = 1e-5) -> CumulativeLink:
    """rows: grade, slots, values. Adam on the whole sample; thresholds stay ordered as steps of softplus."""
    grades = sorted({g for g, _, _ in rows})
    size = 2 * SLOTS + 1
    if len(grades) < 2:
        return CumulativeLink(np.zeros(size), np.zeros(0), grades or [0, TARGET][:1])
    y = np.array([grades.index(g) for g, _, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for _, s, _ in rows])
    col = np.concatenate([s for _, s, _ in rows])
    val = np.concatenate([v for _, _, v in rows])
    k = len(grades) - 1
    share = np.array([(y > i).mean() for i in range(k)])
    first = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(size), first[:1], np.log(np.expm1(np.maximum(np.diff(first), 1e-3)))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        cuts = theta[size] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(theta[size + 1 :])))])
        eta = np.bincount(row, theta[col] * val, len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = sigmoid(edges[y + 1] - eta), sigmoid(edges[y] - eta)
        upper, lower = np.where(y == k, 1.0, upper), np.where(y == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_eta = (du - dl) / len(rows)
        gradient = np.zeros_like(theta)
        gradient[:size] = np.bincount(col, d_eta[row] * val, size) + decay * theta[:size]
        d_cut = np.array([(-du[y == i].sum() + dl[y == i + 1].sum()) / len(rows) for i in range(k)])
        gradient[size] = d_cut.sum()
        for i in range(1, k):
            gradient[size + i] = d_cut[i:].sum() * sigmoid(theta[size + i])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = theta[size] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(theta[size + 1 :])))])
    return CumulativeLink(theta[:size], cuts, grades)


def rated_sample(docs: DataFrame, labels: DataFrame, grade_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """grade, __text of at most `sample` rated documents: those with the smallest hashes of their ids."""
    rated = labels.select(F.col(id_col).alias("__rated"), F.col(grade_col).cast("int").alias("grade")).dropna()
    few = rated.orderBy(F.xxhash64("__rated"), "__rated", "grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col("text").alias("__text"))
    return texts.join(F.broadcast(few), F.col("__id") == F.col("__rated")).select("grade", "__text")


def train_quality(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", sample: int = SAMPLE) -> CumulativeLink:
    """Fits on at most `sample` rated documents. Rows without a grade are left out."""

    def features(batches):
        for batch in batches:
            at, values = [], []
            for text in batch.column("__text").to_pylist():
                own, n = slots(text or "")
                held, counts = np.unique(own, return_counts=True)
                at.append(held)
                values.append((counts / (n + DRAW)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array(at, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float32()))], ["grade", "at", "value"]
            )

    ship(docs.sparkSession)
    rows = rated_sample(docs, labels, grade_col, sample).mapInArrow(features, "grade int, at array<bigint>, value array<float>")
    got = rows.toArrow()
    rows = [
        (g, np.asarray(a.values), np.asarray(v.values, dtype=np.float64))
        for g, a, v in zip(got["grade"].to_pylist(), got["at"], got["value"], strict=True)
    ]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the same model whatever the order of tasks
    return fit(rows)


def score_quality(docs: DataFrame, model: CumulativeLink, target: int = TARGET, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_prob (of the target grade or better) and kept (tail_prob from `keep_from` on).

    Null texts count as empty and get the thresholds' own probabilities. Rows that repeat get equal values. Columns of docs
    that have one of these names are replaced.
    """

    @pandas_udf("double")
    def eta(texts: pd.Series) -> pd.Series:
        return texts.map(model.eta, na_action=None).astype(float)

    ship(docs.sparkSession)
    own = new_name(docs)
    scored = docs.withColumn(own, eta(F.coalesce(F.col(text_col), F.lit(""))))
    scored = scored.withColumn("expected_grade", model.expected(F.col(own)))
    scored = scored.withColumn("tail_prob", model.reach(F.col(own), target))
    return scored.withColumn("kept", F.col("tail_prob") >= keep_from).drop(own)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_prob", "kept")
