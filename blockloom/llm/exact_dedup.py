"""Exact deduplication by an extendible-hash index on shared files.

The index has an entry for each distinct normalised text. Its directory has one slot for each value of a hash's first bits that any entry has;
a bucket is the largest aligned run of slots whose entries fit into `BUCKET_ENTRIES`. That is where directory doubling ends: a
bucket that is too full splits by one more bit until it fits or its slots' bits are used up, from where on it chains its
overflow. The directory has some sixteen slots for each full bucket, whatever the input's size; it is a table like the others and only
joined, and Spark sends it to every task or not by its measured size.

Owner tasks take ranges of buckets and write them in order. Texts of one hash are compared byte for byte when entries are made, so
colliding hashes give separate entries of one chain. A row finds its entry by its slot in the directory, its hash in that bucket, and
in the chain by the SHA-256 of its bytes.

Everything here is DataFrame operations. Copies are counted before the shuffle of texts, so that a text that a
third of the rows share costs one row a task. A row is looked up by a shuffled join, but for texts with more than one in `HOT` of all
rows: of these there are fewer than `HOT`, and they go to every task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import ascii_lower, documents, dropped, written

BUCKET_ENTRIES = 512
#: The directory may double so many times beyond what evenly spread hashes need.
SPARE = 4
HOT = 1_000


def directory(entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(prefix, depth, bucket) for each non-empty slot: the state after all directory doublings.

    entries has a column `prefix`, the first max_depth bits of the hash. `bucket` is the first slot of
    the bucket, so that buckets follow the order of the hashes. The directory begins with a depth at which evenly spread hashes fill buckets
    several times over, so no node has a great share of the slots.
    """
    slots = entries.groupBy("prefix").agg(F.count("*").alias("held"))
    depths = slots.withColumn("depth", F.explode(F.sequence(F.lit(max(0, max_depth - SPARE - 3)), F.lit(max_depth))))
    depths = depths.withColumn("node", F.expr(f"shiftright(prefix, {max_depth} - depth)"))
    full = depths.groupBy("depth", "node").agg(F.sum("held").alias("node_held"))
    fits = (F.col("node_held") <= capacity) | (F.col("depth") == max_depth)
    leaf = depths.join(full, ["depth", "node"]).where(fits).groupBy("prefix").agg(F.min("depth").alias("depth"))
    run = F.expr(f"shiftright(prefix, {max_depth} - depth)")
    return leaf.withColumn("bucket", F.expr(f"shiftleft(1L, {max_depth} - depth)") * run)


class Index:
    """entries: bucket, depth, hash, chain, text_sha256, keep_id, group_size; slots: prefix, depth, bucket."""

    def __init__(self, entries: DataFrame, slots: DataFrame, max_depth: int, rows: int):
        self.entries, self.slots, self.max_depth, self.rows = entries, slots, max_depth, rows

    def find(self, probes: DataFrame) -> DataFrame:
        """probes (hash, sha and others, written) with bucket, chain, keep_id and group_size."""
        own = self.entries.select("bucket", F.col("hash").alias("its"), "chain", F.col("text_sha256").alias("sha2"), "keep_id", "group_size")
        often = F.col("group_size") > self.rows / HOT
        same = (F.col("hash") == F.col("its")) & (F.col("sha") == F.col("sha2"))
        # Fewer than HOT texts can have more than 1 / HOT of the rows.
        hot = F.broadcast(own.where(often))
        common = probes.join(hot, same)
        slots = self.slots.select(F.col("prefix"), F.col("bucket").alias("slot"))
        rest = probes.join(hot, same, "left_anti").withColumn("prefix", prefix_of("hash", self.max_depth)).join(slots, "prefix")
        rest = rest.join(own.where(~often), same & (F.col("slot") == F.col("bucket")))
        return common.unionByName(rest.drop("prefix", "slot")).drop("its", "sha2")


def prefix_of(column: str, depth: int) -> Column:
    return F.shiftrightunsigned(column, 64 - depth)


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, hash_of: Callable[..., Column] = F.xxhash64
) -> Index:
    """The index on docs. `chain` counts the entries of one hash from 0; more than one means a collision. hash_of: any 64-bit hash."""
    keyed = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    keyed = keyed.withColumn("hash", hash_of("norm"))
    groups = keyed.groupBy("hash", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    sha = F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")
    entries = written(groups.select("hash", sha, "keep_id", "group_size"), "dedup-entries")
    whole = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows")).first()
    max_depth = (whole["entries"] // capacity).bit_length() + SPARE
    placed = entries.withColumn("prefix", prefix_of("hash", max_depth))
    slots = written(directory(placed, capacity, max_depth), "dedup-directory")
    placed = placed.join(slots, "prefix").repartitionByRange("bucket", "hash")
    chain = W.partitionBy("bucket", "hash").orderBy("text_sha256")
    placed = written(placed.withColumn("chain", F.row_number().over(chain) - 1).drop("prefix"), "dedup-index")
    dropped(entries)
    return Index(placed, slots, max_depth, whole["rows"])


def looked_up(docs: DataFrame, id_col: str, text_col: str, capacity: int, hash_of: Callable[..., Column]) -> DataFrame:
    """id, hash, sha, bucket, chain, keep_id, group_size: one row per row of docs."""
    index = build_index(docs, id_col, text_col, capacity, hash_of)
    probes = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    probes = probes.select("id", hash_of("norm").alias("hash"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"))
    return index.find(written(probes, "dedup-probes"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, hash_of: Callable[..., Column] = F.xxhash64
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Equal: identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    The row with the largest id stays; null ids lose against any other, and a group with null ids only has
    keep_id null. Rows that repeat id and text are all marked as kept: `drop_copies` leaves one of them.
    Other columns of the input, whatever their names, are ignored. An empty table gives an empty result.
    """
    found = looked_up(docs, id_col, text_col, capacity, hash_of)
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.col("sha").alias("text_sha256"), "bucket", "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns; of rows that repeat id and text, one."""
    found = looked_up(docs, id_col, text_col, BUCKET_ENTRIES, F.xxhash64)
    stays = written(found.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("its"), F.col("sha").alias("kept")).distinct(), "dedup-stays")
    sha = F.sha2(F.encode(ascii_lower(F.col(text_col)), "UTF-8"), 256)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    rows = rows.join(stays, (F.col("sha") == F.col("kept")) & F.col("id").eqNullSafe(F.col("its")), "left_semi")
    one = W.partitionBy("sha", "id").orderBy("sha")
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
