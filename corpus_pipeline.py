"""A training corpus from documents: quality, toxicity, exact copies, near copies, packed sequences.

Every stage works on all that the stage before kept. The filters keep whole rows of documents; the last stage gives
the pieces of the packed sequences. Null texts count as empty, and a row with a null text is judged as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm._shared import documents, dropped, tables_made, written
from blockloom.llm.exact_dedup import drop_copies
from blockloom.llm.jaccard_join import drop_near_copies
from blockloom.llm.packing import pack
from blockloom.llm.quality import score_quality, train_quality
from blockloom.llm.toxicity import score_toxicity, train_toxicity
from blockloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that probably reach the target grade."""
    ship(spark)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("kept").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted to be toxic."""
    ship(spark)
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest id."""
    ship(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.8, the one with the smallest id."""
    ship(spark)
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("packing", packing),
]

#: No SQL: two stages score by models trained here, and packing solves a linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage needed is deleted once its result is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with tables_made() as made:
            result = stage(spark, docs, sf_dir)
            docs = written(result, f"pipeline-{name.replace(' ', '-')}")
        dropped(before, *made[:-1])
        before = docs
    return docs
