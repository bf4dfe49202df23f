"""Minimax contiguous sharding.

Rows with equal texts form one atomic group. Groups stand in the order of their smallest id, and shards are
contiguous runs of groups. The smallest feasible capacity of the largest shard is found by binary search,
each trial filling shards greedily; then the order is cut. The running byte sums live in a table; the search
sees them as at most `CELLS` segments at a time, with the smallest and largest sum in each. A trial that can
be decided from these bounds costs no job; one that can't splits the segments in doubt, all in one job. So the
driver holds a bounded summary at any input size, and the result is exact.

Everything here is DataFrame operations. A text that a third of the rows share is one group row after partial
aggregation; slots are numbered by position in range partitions, never by one task for each shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import documents, written

SHARDS = 16
CELLS = 4096


class Sums:
    """The running sums, as segments that split on demand."""

    def __init__(self, table: DataFrame, total: int, cells: int = CELLS):
        self.table, self.total, self.cells = table, total, cells
        self.low: list[int] = []
        self.high: list[int] = []
        self._split([(0, total)])

    def _split(self, ranges: list[tuple[int, int]]) -> None:
        """Replaces the segments that start and end at these sums by up to `cells` smaller ones each."""
        end = F.col("end")
        label = lambda lo, hi: F.when(
            end.between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.floor((end - lo) * self.cells / (hi - lo + 1)).alias("cell"))
        )
        cell = F.coalesce(*[label(lo, hi) for lo, hi in ranges])
        wanted = reduce(Column.__or__, [end.between(lo, hi) for lo, hi in ranges])
        found = self.table.where(wanted).groupBy(cell.alias("cell")).agg(F.min("end").alias("low"), F.max("end").alias("high"))
        gone = {lo for lo, _ in ranges}
        kept = [(lo, hi) for lo, hi in zip(self.low, self.high, strict=True) if lo not in gone]
        kept += [(r["low"], r["high"]) for r in found.collect()]
        kept.sort()
        self.low, self.high = [x for x, _ in kept], [x for _, x in kept]

    def at_most(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the largest sum that is at most x, and the segment in doubt."""
        i = bisect_right(self.low, x) - 1
        if i < 0:
            return 0, 0, None
        if self.high[i] <= x:
            return self.high[i], self.high[i], None
        return self.low[i], x, i

    def at_least(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the smallest sum that is at least x, and the segment in doubt."""
        i = bisect_left(self.high, x)
        if i == len(self.high):
            return self.total, self.total, None
        if self.low[i] >= x:
            return self.low[i], self.low[i], None
        return x, self.high[i], i

    def exact(self, look, x: int) -> int:
        while True:
            lo, hi, doubt = look(x)
            if doubt is None:
                return lo
            self._split([(self.low[doubt], self.high[doubt])])

    def feasible(self, capacity: int, shards: int) -> bool:
        while True:
            doubts, lo, hi = set(), 0, 0
            for _ in range(shards):
                lo, _, a = self.at_most(lo + capacity)
                _, hi, b = self.at_most(hi + capacity)
                doubts |= {a, b} - {None}
            if lo >= self.total:
                return True
            if hi < self.total:
                return False
            self._split([(self.low[i], self.high[i]) for i in doubts])


def smallest_capacity(sums: Sums, largest: int, shards: int) -> int:
    least, enough = max(largest, -(-sums.total // shards)), -(-sums.total // shards) + largest
    while least < enough:
        middle = (least + enough) // 2
        if sums.feasible(middle, shards):
            enough = middle
        else:
            least = middle + 1
    return least


def cuts(sums: Sums, capacity: int, shards: int) -> list[int]:
    """Where shards end. Of all cuts that keep to the capacity, each is the nearest to an even share of the rest."""
    latest = [sums.total]  # from which place on the remaining shards suffice
    for _ in range(shards - 1):
        latest.append(sums.exact(sums.at_least, latest[-1] - capacity) if latest[-1] > capacity else 0)
    found, start = [], 0
    for k in range(shards - 1):
        even = start + (sums.total - start) // (shards - k)
        below, above = sums.exact(sums.at_most, even), sums.exact(sums.at_least, even)
        near = below if even - below <= above - even else above
        start = min(max(near, latest[shards - 1 - k], start), sums.exact(sums.at_most, start + capacity))
        found.append(start)
    return found


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and groups with the empty texts. Slots follow the
    ids in a shard, nulls first, gapless from 0; rows that repeat id and text get a slot each, in any order. Shards may be empty if there are
    fewer groups than shards; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"),
    )
    keys = written(keys, "shard-keys")
    groups = keys.groupBy("sha").agg(F.min("id").alias("first_id"), F.sum("size").alias("bytes"))
    groups = groups.repartitionByRange("first_id", "sha").withColumn("block", F.spark_partition_id())
    groups = written(groups, "shard-groups")
    before = groups.groupBy("block").agg(F.sum("bytes").alias("held"))
    before = before.withColumn("before", F.sum("held").over(W.orderBy("block")) - F.col("held")).drop("held")
    within = F.sum("bytes").over(W.partitionBy("block").orderBy("first_id", "sha"))
    groups = groups.withColumn("within", within).join(before, "block")
    groups = written(groups.select("sha", "bytes", (F.col("within") + F.col("before")).alias("end")), "shard-sums")
    whole = groups.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    ends: list[int] = []
    if whole["total"]:
        sums = Sums(groups, whole["total"])
        ends = cuts(sums, smallest_capacity(sums, whole["largest"], shards), shards)
    place = reduce(Column.__add__, [(F.col("end") > x).cast("int") for x in ends], F.lit(0))
    owners = written(groups.select("sha", place.alias("shard")), "shard-owners")
    placed = keys.join(owners, "sha").repartitionByRange("shard", "id", "sha").withColumn("block", F.spark_partition_id())
    placed = written(placed.drop("sha"), "shard-placed")
    held = placed.groupBy("block", "shard").agg(F.count("*").alias("held"))
    held = held.withColumn("first", F.sum("held").over(W.partitionBy("shard").orderBy("block")) - F.col("held")).drop("held")
    rank = F.row_number().over(W.partitionBy("block", "shard").orderBy("id", "text_crc32")) - 1
    return (
        placed.withColumn("rank", rank)
        .join(held, ["block", "shard"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("rank") + F.col("first")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
