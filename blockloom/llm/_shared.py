"""Helpers the data-preparation operators have in common."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows go to Python workers in batches of about so many bytes while `written` writes, unless the session says how many.
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it.

    Only a local master may go without the setting: there, one machine is the whole cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that `written` makes meanwhile and nothing has dropped."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds batches in bytes: 10,000 long texts at once would be held by the executor's JVM and by the worker, several times each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` gave, once all that was read from them is written itself."""
    for t in tables:
        if t is not None:
            jvm = t.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(t.folder)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_name(df: DataFrame) -> str:
    """A name that no column of df has."""
    name = "own"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other change; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
