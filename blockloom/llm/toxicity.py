"""Toxicity by weak supervision.

From a bounded sample of labelled rows come words and word beginnings that stand in toxic documents far more often
than in others. They make lexicons, one set for each of `FOLDS` parts of the sample, mined from all rows but those of that part; so what votes on a document
has never seen its label. Voters of several kinds (whole words, beginnings of each length, strong ones only, several at once, their
density, and absence) vote toxic, clean or not at all.

A generative label model has, for each class, every voter's mean vote (its accuracy) and, for both, the covariance of all voters' votes
(their correlations). The covariance is that around the majority's opinion; expectation maximisation estimates the means from the votes
alone. A voter counts by what its correlated fellows don't say already. A linear classifier is then trained on the posterior labels, over the words and beginnings mined from the whole
sample, at most `MINED`, and scores every whole text.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1, and serve for mining only. Only the text is an input of a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship
from ._shared import documents, dropped, written

SAMPLE = 16_000
MINED = 3_000
ODDS = 8.0
#: How many mined terms may be toxic by chance alone.
BY_CHANCE = 0.5
PREFIXES = (4, 5, 6)
FOLDS = 8
#: From these odds on a term is strong.
STRONG = 64.0
#: From this share of a text's distinct words on, mined words are dense.
DENSE = 0.01
FLAG_FROM = 0.7
WORDS = re.compile(r"[^\W_]+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Words, and word beginnings marked with a star."""
    words = set(WORDS.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in PREFIXES))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """id, toxic, text of at most `sample` rows that labels may be learnt from: those with the smallest hashes of their ids.

    Of copies and near copies (equal least hash of their four-word shingles) the one with the smallest id stays, so that no
    text's words count as evidence many times.
    """
    usable = labels.where(~held_out(id_col)).select(F.col(id_col).alias("__labelled"), F.col("toxic").cast("int").alias("toxic")).dropna()
    few = usable.orderBy(F.xxhash64("__labelled"), "__labelled", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(few), F.col("__id") == F.col("__labelled")).select(F.col("__id").cast("long").alias("id"), "toxic", "text")

    def keyed(batches):
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                words = WORDS.findall(text.lower())
                keys.append(min((zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["id", "toxic", "text", "key"])

    keys = written(found.mapInArrow(keyed, "id bigint, toxic int, text string, key bigint"), "toxicity-labelled")
    first = keys.groupBy("key").agg(F.min("id").alias("id"))
    return keys.join(F.broadcast(first), ["key", "id"]).dropDuplicates(["key", "id"]).select("id", "toxic", "text")


def fold_of(id_col: str = "id") -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


def mine(sampled: DataFrame, most: int = MINED) -> tuple[list[str], list[dict[str, float]]]:
    """(terms, lexicons): the terms with the greatest odds for toxic documents, at most `most`, best first; and for each fold the
    odds of those that all other folds' rows give.

    A term's documents must be toxic so often that of all terms fewer than `BY_CHANCE` would be so without a cause: by
    the Chernoff bound on b or more toxic documents out of n, times the number of terms.
    """

    def count(batches):
        for batch in batches:
            held = [sorted(terms_of(t)) for t in batch.column("text").to_pylist()]
            n = [len(h) for h in held]
            columns = [pa.array([t for h in held for t in h], pa.string()), *(pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n), pa.int32()) for c in ("toxic", "fold"))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "fold"])

    rows = sampled.groupBy(fold_of().alias("fold")).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).collect()
    total, bad = sum(r["n"] for r in rows), sum(r["bad"] for r in rows)
    if not 0 < bad < total:
        return [], [{} for _ in range(FOLDS)]
    without = {f: (total - sum(r["n"] for r in rows if r["fold"] == f), bad - sum(r["bad"] for r in rows if r["fold"] == f)) for f in range(FOLDS)}
    held = sampled.select("toxic", "text", fold_of().alias("fold")).mapInArrow(count, "term string, toxic int, fold int").groupBy("term")
    here = [F.sum((F.col("fold") == f).cast("int") * x).alias(f"{k}{f}") for f in range(FOLDS) for k, x in (("b", F.col("toxic")), ("g", 1 - F.col("toxic")))]
    held = written(held.agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"), *here).where("b >= 2"), "toxicity-terms")
    least = float(np.log(max(1, held.count()) / BY_CHANCE))

    def odds(b: Column, g: Column, n: int, of_these: int) -> Column:
        """The odds, null where they may be chance. Of fewer rows, less is asked in proportion, so that lexicons reach as far as the terms."""
        share = min(max(of_these / max(n, 1), 1e-9), 1 - 1e-9)
        seen = F.greatest(b + g, F.lit(1))
        surprise = F.when(b > 0, b * F.log(b / seen / share)).otherwise(0.0) + F.when(g > 0, g * F.log(g / seen / (1 - share))).otherwise(0.0)
        out = ((b + 0.5) / (of_these + 1)) / ((g + 0.5) / (n - of_these + 1))
        return F.when((b >= 2) & (out >= ODDS) & (surprise >= least * n / total), out)

    every = [odds(F.col("b"), F.col("g"), total, bad).alias("odds")]
    every += [odds(F.col("b") - F.col(f"b{f}"), F.col("g") - F.col(f"g{f}"), *without[f]).alias(f"odds{f}") for f in range(FOLDS)]
    found = held.select("term", *every).where(F.coalesce("odds", *[f"odds{f}" for f in range(FOLDS)]).isNotNull())
    got = found.orderBy(F.desc_nulls_last("odds"), "term").limit(2 * most).collect()
    dropped(held)
    return [r["term"] for r in got if r["odds"] is not None][:most], [{r["term"]: r[f"odds{f}"] for r in got if r[f"odds{f}"] is not None} for f in range(FOLDS)]


def votes(hits: list[str], lexicon: dict[str, float], words: int) -> list[int]:
    """1 toxic, -1 clean, 0 abstains; hits are a text's mined terms, words its number of distinct ones."""
    own = [h for h in hits if h in lexicon]
    out = []
    for n in (0, *PREFIXES):
        odds = [lexicon[h] for h in own if (len(h) - 1 if h.endswith("*") else 0) == n]
        out += [int(len(odds) >= 1), int(max(odds, default=0) >= STRONG), int(len(odds) >= 2)]
    return [*out, int(sum(not h.endswith("*") for h in own) >= max(1, DENSE * words)), 1 if len(own) >= 4 else 0 if own else -1]


@dataclass
class LabelModel:
    """The mean votes of each class, the inverse of the votes' covariance within classes, and the log odds of the classes before any vote."""

    mean: np.ndarray
    inverse: np.ndarray
    prior: float

    @property
    def weight(self) -> np.ndarray:
        """What a vote adds to the log odds."""
        return self.inverse @ (self.mean[1] - self.mean[0])

    def posterior(self, given: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + (given - self.mean.mean(0)) @ self.weight, -30, 30)))


def majority(given: np.ndarray) -> np.ndarray:
    """What most voters that don't abstain say, as a first posterior."""
    return np.clip(((given > 0).sum(1) + 0.1) / ((given != 0).sum(1) + 0.2), 0.02, 0.98)


def fit_label_model(given: np.ndarray, start: np.ndarray | None = None, rounds: int = 50, ridge: float = 0.05) -> LabelModel:
    """The correlations as the first posterior has them, then expectation maximisation over voters' means; no label is an input.

    start: the first posterior, by default the majority's opinion. ridge: the share of a voter's whole variance that counts as its own error. Were
    the correlations estimated anew each round, the voters that agree most would become the label.
    """
    p, inverse = majority(given) if start is None else start, None
    for _ in range(rounds):
        q = np.stack([1 - p, p]) + 1e-6
        mean = q @ given / q.sum(1, keepdims=True)
        if inverse is None:
            rest = [given - mean[y] for y in (0, 1)]
            spread = sum((r * q[y][:, None]).T @ r for y, r in enumerate(rest)) / len(given)
            inverse = np.linalg.inv(spread + np.diag(ridge * given.var(0) + 1e-3))
        share = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        model = LabelModel(mean, inverse, float(np.log(share / (1 - share))))
        p = model.posterior(given)
    return model


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str) -> float:
        words = set(WORDS.findall(text.lower()))
        found = self.weights.keys() & words
        for n in PREFIXES:
            found |= self.weights.keys() & {w[:n] + "*" for w in words if len(w) >= n}
        return float(1 / (1 + np.exp(-np.clip(self.intercept + sum(sorted(self.weights[t] for t in found)), -30, 30))))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 1_000) -> ToxicityModel:
    """Mines at most `sample` labelled rows. Without a toxic or a clean one, every score is the share of toxic rows (0 if none)."""
    ship(docs.sparkSession)
    sampled = written(labelled_sample(docs, labels, sample), "toxicity-sample")
    terms, lexicons = mine(sampled)
    place = {t: i for i, t in enumerate(terms)}
    every = frozenset(place).union(*lexicons)

    def look(batches):
        for batch in batches:
            found, words = [], []
            for t in batch.column("text").to_pylist():
                own = terms_of(t)
                found.append(sorted(every & own))
                words.append(sum(not x.endswith("*") for x in own))
            columns = [*(batch.column(c) for c in ("id", "toxic", "fold")), pa.array(found, pa.list_(pa.string())), pa.array(words, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "fold", "hits", "words"])

    looked = sampled.select("id", "toxic", "text", fold_of().alias("fold")).mapInArrow(look, "id bigint, toxic int, fold int, hits array<string>, words int")
    seen = looked.orderBy("id", "toxic").toArrow()
    share = float(np.mean(seen["toxic"].to_numpy())) if seen.num_rows else 0.0
    dropped(sampled)
    if not terms or share in (0.0, 1.0):
        return ToxicityModel({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    hits, folds = seen["hits"].to_pylist(), seen["fold"].to_pylist()
    given = np.array([votes(h, lexicons[f], n) for h, f, n in zip(hits, folds, seen["words"].to_pylist(), strict=True)], float)
    labels_for = fit_label_model(given).posterior(given)
    hits = [[t for t in h if t in place] for h in hits]

    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.array([place[t] for h in hits for t in h], dtype=np.int64)
    theta = np.zeros(len(terms) + 1)
    theta[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[col], len(hits)) + theta[-1], -30, 30)))
        error = (p - labels_for) / len(hits)
        gradient = np.append(np.bincount(col, error[row], len(terms)), error.sum())
        gradient[:-1] += 1e-6 * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:-1] = np.maximum(theta[:-1], 0)  # every term was mined for being toxic
    return ToxicityModel(dict(zip(terms, theta[:-1].tolist(), strict=True)), float(theta[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", flag_from: float = FLAG_FROM) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score reaches `flag_from`).

    Null texts count as empty and get the score without any term. Rows that repeat get equal scores. Columns of docs
    that have one of these names are replaced.
    """

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype(float)

    ship(docs.sparkSession)
    scored = docs.withColumn("score", score(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= flag_from).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
