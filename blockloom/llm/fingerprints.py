"""Document fingerprints: SimHash over word shingles, and search within a Hamming radius.

A document's terms are its five-word shingles (fewer words: the whole sequence); a term's weight is how often it
occurs. Each term's 128-bit hash votes with its weight, for or against each bit; where votes are equal, the term with the
smallest hash decides, so that short texts don't lean to the empty text's fingerprint.

Two texts whose shingles have Jaccard similarity J differ in about 128 / pi * acos(2 J / (1 + J)) bits: 19.4 +- 4.1 at 0.8.
`RADIUS` is two deviations above that, so near copies are found from 0.8 on; unrelated texts differ in 64 +- 5.7 bits.

Fingerprints within a small radius r agree in at least one of r + 1 blocks of bits. So there is one table for each block,
permuted to have that block in front; equal front blocks are candidates, and the distance is then computed. Every
pair is counted in the first table in which it meets. At `RADIUS`, blocks would have 4 bits and every pair would meet, so
there each query is compared with each distinct fingerprint, as whole arrays.

The next document in order of ids is found without a global sort in one task: ranges of ids, as a sample of them has it, form blocks of
about as many rows each, a block is sorted by one task, and the first row of each block also goes to the block before.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship
from ._shared import documents, written

SHINGLE = 5
BITS = 128
RADIUS = 28
TABLE_RADII = (1, 3, 7)
QUERIES_AT_ONCE = 16
#: Blocks of rows in order of ids, at most; their first ids go to every task.
BLOCKS = 16_384
#: Votes of so many shingles are summed at a time.
TERMS_AT_ONCE = 1 << 15
ROWS_A_BLOCK = 1_000
REMEMBERED = 400_000
ROWS_AT_ONCE = 256
QUERY_EVERY = 100


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SimHash:
    """Fingerprints of texts; remembers word hashes, at most `remembered`."""

    def __init__(self, shingle: int = SHINGLE, remembered: int = REMEMBERED):
        self.shingle, self.remembered = shingle, remembered
        self.known: dict[str, int] = {}
        self.factors = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(shingle)]

    def word_hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes for each shingle."""
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += words[i : i + n] * self.factors[i]
        low = mixed(total + np.uint64(k))
        return np.stack([low, mixed(low ^ total)], axis=1)

    def fingerprint(self, text: str) -> bytes:
        words = text.lower().split()
        if not words:
            return bytes(BITS // 8)
        lead, least = np.zeros(BITS, np.int64), None
        for at in range(0, max(1, len(words) - self.shingle + 1), TERMS_AT_ONCE):
            terms = self.terms(self.word_hashes(words[at : at + TERMS_AT_ONCE + self.shingle - 1]))
            votes = np.unpackbits(terms.view(np.uint8).reshape(-1, BITS // 8), axis=1)
            lead += 2 * votes.sum(axis=0, dtype=np.int64) - len(votes)
            k = int(terms[:, 0].argmin())
            if least is None or terms[k, 0] < least[0]:
                least = (terms[k, 0], votes[k])
        return np.packbits(np.where(lead == 0, least[1], lead > 0)).tobytes()


@lru_cache(maxsize=1)
def hasher() -> SimHash:
    return SimHash()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def halves(fingerprint: bytes) -> tuple[int, int]:
    return tuple(int.from_bytes(fingerprint[i : i + 8], "big", signed=True) for i in (0, 8))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """id, text, block, tail: rows in order of their ids within blocks; at a block's end (tail 1) the row that follows.

    Order: null ids first, then ascending; equal ids by text. The last block's tail is the first row of all. Blocks hold about as many rows each, however
    the ids are spread.
    """
    spark = docs.sparkSession
    read = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ids = docs.select(docs[id_col].cast("long").alias("id"))
    whole = ids.agg(F.count("id").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    blocks = min(BLOCKS, max(1, whole["n"] // rows_a_block))
    ranged = ids.where("id is not null").repartitionByRange(blocks, "id").withColumn("range", F.spark_partition_id())
    firsts = np.array(sorted(r["first"] for r in ranged.groupBy("range").agg(F.min("id").alias("first")).collect()), np.int64)
    held = spark.sparkContext.broadcast((firsts, whole["nulls"] > 0))

    @pandas_udf("own int, before int")
    def place(known: pd.Series, values: pd.Series) -> pd.DataFrame:
        bounds, nulls = held.value
        at, null = values.to_numpy(np.int64), ~known.to_numpy(bool)
        own = np.maximum(np.searchsorted(bounds, at, side="right") - 1, 0)
        own[null] = 0
        begins = np.zeros(len(own), bool)
        if len(bounds):
            begins = (bounds[own] == at) & ~null & ((own > 0) | (not nulls))
        before = np.where(begins | null, (own - 1) % max(1, len(bounds)), -1)
        return pd.DataFrame({"own": own.astype(np.int32), "before": before.astype(np.int32)})

    placed = read.withColumn("place", place(F.col("id").isNotNull(), F.coalesce("id", F.lit(0))))
    own = F.struct(F.col("place.own").alias("block"), F.lit(0).alias("tail"))
    again = F.struct(F.col("place.before").alias("block"), F.lit(1).alias("tail"))
    to = F.when(F.col("place.before") >= 0, F.array(own, again)).otherwise(F.array(own))
    sent = placed.select("id", "text", F.explode(to).alias("to")).select("id", "text", "to.block", "to.tail")
    return sent.repartition("block").sortWithinPartitions("block", "tail", F.asc_nulls_first("id"), "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, hi, lo: one row per input row.

    Null texts count as empty; an empty text has the fingerprint 0. Of a single row, the row itself is the next. Ids are
    integers; nulls come first. hi and lo are the fingerprint's halves as signed integers. Other columns are ignored.
    """

    def run(batches):
        simhash = hasher()

        def row(this, that):
            (key, text, own), (_, follows, its) = this, that
            half = len(text) // 2
            edited = text[: len(text) - half] + follows[:half]
            changed = simhash.fingerprint(edited) if edited != text else own
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return (key, len(text), sha, own.hex(), changed.hex(), likeness(own, changed), likeness(own, its), *halves(own))

        def paired():
            held = block = None
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(start, ROWS_AT_ONCE)
                    for key, text, b, tail in zip(*(part.column(k).to_pylist() for k in ("id", "text", "block", "tail")), strict=True):
                        if tail and (held is None or b != block):
                            continue  # a second row of the id that follows
                        this = (key, text, simhash.fingerprint(text))
                        if held is not None and b == block:
                            yield row(held, this)
                        held, block = (None if tail else this), b

        def packed(rows):
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"]
        rows = []
        for r in paired():
            rows.append(r)
            if len(rows) == 2_000:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi bigint, lo bigint"
    ship(docs.sparkSession)
    return in_blocks(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def block_value(block: int, blocks: int, half: str = "{}") -> Column:
    """One of `blocks` equal blocks of the fingerprint's bits, as an integer; half: SQL for a half, with {} for its name."""
    width, per_half = BITS // blocks, blocks // 2
    bits = half.format(*["hi" if block < per_half else "lo"] * half.count("{}"))
    if width == 64:
        return F.expr(bits)
    return F.expr(f"shiftrightunsigned({bits}, {64 - width * (block % per_half + 1)}) & {(1 << width) - 1}L")


def count_within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n: for each distinct fingerprint of queries, how many rows of corpus lie within the radius.

    Both have columns hi and lo. Radius 1, 3 or 7 is searched by radius + 1 blocks of equal width, any other by comparing
    all. Equal fingerprints are counted before the join, so copies meet once.
    """
    if radius not in TABLE_RADII:
        return count_by_comparing(queries, corpus, radius)
    blocks = radius + 1
    table = lambda df: df.select("*", F.posexplode(F.array(*[block_value(b, blocks) for b in range(blocks)])).alias("table", "front"))
    left = table(queries.select("hi", "lo").distinct())
    right = table(corpus.groupBy("hi", "lo").agg(F.count("*").alias("n"))).toDF("hi2", "lo2", "n", "table", "front")
    x, y = F.col("hi").bitwiseXOR(F.col("hi2")), F.col("lo").bitwiseXOR(F.col("lo2"))
    apart = F.bit_count(x) + F.bit_count(y)
    differs = left.join(right, ["table", "front"]).where(apart <= radius)
    first = F.coalesce(*[F.when(block_value(b, blocks, "({} ^ {}2)") == 0, F.lit(b)) for b in range(blocks)])
    return differs.where(F.col("table") == first).groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def count_by_comparing(queries: DataFrame, corpus: DataFrame, radius: int) -> DataFrame:
    """As count_within, for any radius. The distinct queries go to every task, 16 bytes each; the corpus is dealt out."""
    spark = corpus.sparkSession
    asked = queries.select("hi", "lo").distinct().toArrow()
    held = spark.sparkContext.broadcast([asked.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")])

    def run(batches):
        hi, lo = held.value
        within = np.zeros(len(hi), np.int64)
        for batch in batches:
            hi2, lo2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            n = batch.column("n").to_numpy()
            for start in range(0, len(hi) if len(n) else 0, QUERIES_AT_ONCE):
                some = slice(start, start + QUERIES_AT_ONCE)
                apart = np.bitwise_count(hi[some, None] ^ hi2) + np.bitwise_count(lo[some, None] ^ lo2)
                at = np.flatnonzero(apart <= radius)
                np.add.at(within, start + at // len(n), n[at % len(n)])
        near = np.flatnonzero(within)
        columns = [pa.array(x[near].view(np.int64)) for x in (hi, lo, within)]
        yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "n"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counted = corpus.groupBy("hi", "lo").agg(F.count("*").alias("n")).repartition(tasks, "hi", "lo")
    return counted.mapInArrow(run, "hi bigint, lo bigint, n bigint").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds near_docs: for ids divisible by 100, how many other documents have a fingerprint within the radius; else null."""
    found = written(fingerprint_documents(documents(spark, sf_dir)), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    queries = found.where(asks)
    near = count_within(queries, found).withColumn("near_docs", F.col("n") - 1).drop("n")
    answered = queries.join(near, ["hi", "lo"])
    rest = found.where(~asks).withColumn("near_docs", F.lit(None).cast("long"))
    return answered.unionByName(rest).drop("hi", "lo")
