"""Rows as pieces of byte streams, cut into chunks of equal size without a task for a whole stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELL = 4096


def concatenated(pieces: Column, of) -> Column:
    """The binary values `of` an array's elements, one behind the other, in linear time; no elements give no bytes."""
    return F.unhex(F.array_join(F.transform(pieces, lambda x: F.hex(of(x))), ""))


def with_offsets(rows: DataFrame, stream: str, order: str, size: str, cell: int = CELL) -> DataFrame:
    """rows with `offset`, the sum of size before each row of its stream: within cells of the order, then over cells."""
    rows = rows.withColumn("__cell", F.floor(F.col(order) / cell))
    sums = rows.groupBy(stream, "__cell").agg(F.sum(size).alias("__held"))
    before = F.coalesce(F.sum("__held").over(W.partitionBy(stream).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(stream, "__cell", before.alias("__before"))
    inside = W.partitionBy(stream, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(sums, [stream, "__cell"]).withColumn("offset", F.col("__before") + F.col("__inside")).drop("__cell", "__inside", "__before")


def chunks(rows: DataFrame, stream: str, order: str, data: str, chunk: int) -> DataFrame:
    """(stream, chunk_no, raw): the streams' bytes in chunks; only bytes of one chunk meet in a task.

    stream and order aren't null, and no two rows share both; order gives the same values whenever it is computed again.
    """
    placed = rows.select(stream, order, F.octet_length(data).alias("__n"))
    placed = with_offsets(placed, stream, order, "__n").select(stream, order, "offset")
    pieces = rows.select(stream, order, F.col(data).alias("__data")).join(placed, [stream, order])
    first = F.floor(F.col("offset") / chunk)
    last = F.floor((F.col("offset") + F.greatest(F.octet_length("__data"), F.lit(1)) - 1) / chunk)
    pieces = pieces.select("*", F.explode(F.sequence(first, last)).alias("chunk_no"))
    start = F.greatest(F.col("chunk_no") * chunk - F.col("offset"), F.lit(0))
    stop = F.least((F.col("chunk_no") + 1) * chunk - F.col("offset"), F.octet_length("__data").cast("long"))
    part = F.substring(F.col("__data"), (start + 1).cast("int"), (stop - start).cast("int"))
    pieces = pieces.select(stream, "chunk_no", "offset", order, part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", order, "part")))
    return pieces.groupBy(stream, "chunk_no").agg(concatenated(ordered, lambda x: x["part"]).alias("raw"))
