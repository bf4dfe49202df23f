"""Directories of arriving files: rows are packed as they come, and packed files are unpacked as they come."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import runs
from ..operators import codec
from ..plans.shared import new_folder


def pack_stream(rows: DataFrame, folder: str, checkpoint: str, level: int = 9) -> StreamingQuery:
    """rows (one column `line`) as files of lines in Spark's own bzip2 text sink for level 9, else as values of a column `packed`:
    streams of about a block's lines each, in order within a partition, a line end behind each line; null lines are empty."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        stream_of = lambda: pa.RecordBatch.from_arrays([pa.array([bz2.compress(b"".join(held), level)], pa.binary())], ["packed"])
        for b in batches:
            for line in b.column("line").cast(pa.binary()).to_pylist():
                line = (line or b"") + b"\n"
                if held and size + len(line) > runs.safe_chunk(level):
                    yield stream_of()
                    held, size = [], 0
                held.append(line)
                size += len(line)
        if held:
            yield stream_of()

    def each(batch: DataFrame, number: int) -> None:
        if level == 9:
            batch.write.mode("overwrite").option("compression", "bzip2").text(f"{folder}/batch={number}")
        else:
            batch.select("line").mapInArrow(packed, "packed binary").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unpack_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, files_a_batch: int = 64) -> StreamingQuery:
    """Files *.bz2 that arrive under a folder, as lines in Parquet, empty lines too; an empty file has none. A damaged file stops the query, and none of its lines is written."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.bz2")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_a_batch)
        .load(folder)
    )

    def each(batch: DataFrame, number: int) -> None:
        got = batch.select("path", codec.decompressed(F.col("content")).alias("got"))
        bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("got.error"))).cast("string")
        text = F.when(F.col("got.error").isNull(), F.decode("got.raw", "UTF-8")).otherwise(bad)
        texts = got.select(text.alias("text")).where("text <> ''")
        ended = F.when(F.endswith("text", F.lit("\n")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
        lines = texts.select(F.explode(F.split(ended, "\n")).alias("line"))
        lines.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_through_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, packed in micro-batches, and unpacked again as the files arrive."""
    base = new_folder(spark, "events")
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    kept = ["event_id", "user_id", "event_type", "props"]
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}*").select(F.to_json(F.struct(*kept)).alias("line"))
    pack_stream(rows, f"{base}/packed", f"{base}/pack").awaitTermination()
    unpack_stream(spark, f"{base}/packed", f"{base}/lines", f"{base}/unpack").awaitTermination()
    lines = spark.read.schema("line string, batch int").parquet(f"{base}/lines")
    fields = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in kept)
    return lines.select(F.from_json("line", fields).alias("x")).select("x.*")
