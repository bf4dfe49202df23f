"""The registered queries of the block engine, and their SQL where there is any."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import block, crc, huffman, runs, transform
from ..operators import codec, report, stages
from ..session import ship
from .offsets import chunks, concatenated
from .shared import stored

CHUNK = runs.safe_chunk(1)
FEW = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary(name: str):
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


# Round trips


def round_trip(name: str, keys: list[str], text: str, level: int = 9) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        packed = table(spark, sf_dir, name).select(*keys, codec.compressed(F.encode(text, "UTF-8"), level).alias("packed"))
        return packed.select(*keys, F.decode(codec.decompressed(F.col("packed"))["raw"], "UTF-8").alias(text))

    return run


def roundtrip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation")
    tries = []
    for level in range(1, 10):
        packed = codec.compressed(F.encode("n_name", "UTF-8"), level)
        back = names.select(F.lit(level).alias("lvl"), "n_nationkey", packed.alias("packed"), F.substring(packed, 1, 4).alias("head"))
        raw = F.decode(codec.decompressed(F.col("packed"))["raw"], "UTF-8")
        tries.append(back.select("lvl", "n_nationkey", raw.alias("n_name"), F.decode("head", "UTF-8").alias("header")))
    out = tries[0]
    for t in tries[1:]:
        out = out.unionByName(t)
    return out


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as one stream of bytes, a line end behind each, in chunks that make one block each."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(binary("text"), F.lit(b"\n")).alias("data"))
    return chunks(docs, "source", "doc_id", "data", CHUNK)


def roundtrip_block_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each source are encoded, put into streams of their own, found by their markers and decoded."""
    raw = source_chunks(spark, sf_dir).withColumn("file_id", F.xxhash64("source", "chunk_no"))
    names = raw.select("file_id", "source", "chunk_no")
    encoded = codec.encode_blocks(raw.select("file_id", F.lit(0).cast("long").alias("block_no"), "raw"), 1)
    files = codec.assemble(encoded, 1).select("file_id", F.col("packed").alias("content"))
    blocks = codec.decode_segments(codec.segments(files)).where("kind = 'block'")
    back = blocks.groupBy("file_id").agg(F.sum(F.octet_length("raw")).alias("n_bytes"), F.min(F.md5("raw")).alias("md5"))
    return back.join(names, "file_id").select("source", "chunk_no", "n_bytes", "md5")


def few_documents(spark: SparkSession, sf_dir: str, cell: int = FEW) -> DataFrame:
    """(file_id, parts): the documents of `cell` successive ids in order."""
    docs = table(spark, sf_dir, "documents").withColumn("file_id", F.floor(F.col("doc_id") / cell))
    return docs.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", binary("text").alias("data")))).alias("parts"))


def one_after_another(parts, data: str):
    return concatenated(parts, lambda x: x[data])


def concat_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each document; the streams of some documents in a row are read as one file."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / FEW).alias("file_id"), "doc_id", codec.compressed(binary("text"), 3).alias("packed"))
    files = docs.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "packed"))).alias("parts"))
    got = files.select("file_id", codec.decompressed(one_after_another(F.col("parts"), "packed")).alias("got"))
    return got.select("file_id", F.col("got.streams").alias("streams"), F.octet_length("got.raw").alias("n_bytes"), F.md5("got.raw").alias("md5"))


def multi_block_files(spark: SparkSession, sf_dir: str, level: int = 1) -> DataFrame:
    """(file_id, content): files of several blocks, one for each `FEW` documents."""
    whole = few_documents(spark, sf_dir).select("file_id", one_after_another(F.col("parts"), "data").alias("content"))
    encoded = codec.encode_blocks(codec.split_blocks(whole, level), level)
    empty = whole.where(F.octet_length("content") == 0).select("file_id", codec.compressed(F.col("content"), level).alias("content"))
    return codec.assemble(encoded, level).select("file_id", F.col("packed").alias("content")).unionByName(empty)


def segment_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many blocks, decoded block by block and checked as streams."""
    blocks, told = codec.decode_files(multi_block_files(spark, sf_dir))
    whole = codec.whole_files(blocks, told)
    found = whole.join(told.drop("error"), "file_id")
    return found.select("file_id", "streams", "trailing", "error", F.octet_length("raw").alias("n_bytes"), F.md5("raw").alias("md5"))


def false_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like segment_decode, with each file's first block cut at a bit where no marker stands, and repaired."""
    parts = codec.segments(multi_block_files(spark, sf_dir))

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = (1, 7, 48, 12_345)[row["file_id"] % 4]
                if row["seq"] == 1 and row["kind"] == "block" and at < row["bit_length"]:
                    bit, whole = row["first_bit"] + at, row["bytes"]
                    rows = [
                        row | {"seq": 2 * row["seq"], "bit_length": at, "bytes": whole[: bit + 7 >> 3]},
                        row | {"seq": 2 * row["seq"] + 1, "start_bit": row["start_bit"] + at, "first_bit": bit & 7, "bit_length": row["bit_length"] - at, "bytes": whole[bit >> 3 :]},
                    ]
                else:
                    rows = [row | {"seq": 2 * row["seq"]}]
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    parts = parts.mapInArrow(cut, parts.schema)
    decoded = codec.repair(stored(codec.decode_segments(parts), "decoded"), parts)
    told = codec.check_streams(codec.with_openings(decoded, parts))
    whole = codec.whole_files(decoded, told)
    return whole.select("file_id", "error", F.octet_length("raw").alias("n_bytes"), F.md5("raw").alias("md5"))


def inverse_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last column and origin of each short text, put back."""
    column = sql(stages.bwt_column, SHORT)(spark, sf_dir)
    origin = sql(stages.bwt_origin, SHORT)(spark, sf_dir).select("k", "origin")
    kept = column.groupBy("k").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "byte"))), lambda x: x["byte"]), "")).alias("last"))

    @pandas_udf("string")
    def back(last: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([transform.inverse(bytes(x), int(o)).decode() for x, o in zip(last, at, strict=True)])

    return kept.join(origin, "k").select("k", back("last", "origin").alias("x"))


def rle1_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    @pandas_udf("binary")
    def both(values: pd.Series) -> pd.Series:
        return values.map(lambda v: runs.decode(runs.encode(bytes(v))))

    return table(spark, sf_dir, "documents").select("doc_id", F.decode(both(binary("text")), "UTF-8").alias("text"))


# What must be refused, ignored or reported


def trailing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = {"none": b"", "garbage": b"garbage", "zero": b"\0", "zeros": bytes(100), "header": b"BZ", "marker": block.BLOCK_MAGIC.to_bytes(6, "big") + b"\0\0"}
    variants = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(v).alias("tail")) for k, v in tails.items()]))
    docs = table(spark, sf_dir, "documents").select("doc_id", codec.compressed(binary("text")).alias("packed"), F.octet_length(binary("text")).alias("n"))
    got = docs.select("doc_id", "n", "packed", variants.alias("v")).select("doc_id", "n", "v.variant", codec.decompressed(F.concat("packed", "v.tail")).alias("got"))
    return got.select("doc_id", "variant", F.col("got.trailing").alias("trailing"), (F.octet_length("got.raw") == F.col("n")).alias("ok"))


def refused(spoil: Callable[[bytes, int], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        @pandas_udf("binary")
        def spoiled(values: pd.Series, ids: pd.Series) -> pd.Series:
            return pd.Series([spoil(bytes(v), int(i)) for v, i in zip(values, ids, strict=True)], dtype=object)

        docs = table(spark, sf_dir, "documents").select("doc_id", codec.compressed(binary("text"), 1).alias("packed"))
        got = docs.select("doc_id", codec.decompressed(spoiled("packed", "doc_id")).alias("got"))
        return got.select("doc_id", F.col("got.error").alias("error"), F.col("got.raw").isNull().alias("refused"))

    return run


def flip(data: bytes, key: int) -> bytes:
    """Damage to the first block's checksum, which no decoder may overlook."""
    at = 10 + key % 4
    return data[:at] + bytes([data[at] ^ 0x10]) + data[at + 1 :]


def cut_off(data: bytes, key: int) -> bytes:
    return data[: (3, 4, 10, len(data) // 2, len(data) - 1)[key % 5]]


def not_bzip2(data: bytes, key: int) -> bytes:
    return (b"", b"plain text, not bzip2", b"BZh0", data[1:])[key % 4]


def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command's test mode: every file decoded, its bytes discarded."""
    _, told = codec.decode_files(multi_block_files(spark, sf_dir))
    return told.select("file_id", F.col("error").isNull().alias("ok"), "trailing", "exit_code")


# Relational stages

SHORT = """(SELECT concat('n', n_nationkey) AS k, n_name AS x FROM nation UNION ALL SELECT concat('r', r_regionkey), r_name FROM region
UNION ALL SELECT concat('p', p_partkey), p_name FROM part) AS t"""
LENGTHS = "(SELECT l.k, CAST(s AS INT) AS symbol, n AS len FROM (VALUES {}) AS l(k, s, n)) AS t"
CODES = {"a": [3, 2, 3, 2, 2], "b": [1, 2, 3, 4, 4], "c": [2, 2, 2, 2], "d": [7, 7, 6, 5, 4, 3, 2, 1]}
LENGTHS = LENGTHS.format(", ".join(f"('{k}', {s}, {n})" for k, own in CODES.items() for s, n in enumerate(own)))
COUNTS = "(SELECT doc_id AS k, n_chars AS n FROM documents) AS t"
SUFFIXES = ("", ".bz2", ".bz", ".tbz2", ".tbz", ".tar", ".Z")
NAMES = "(SELECT concat(page_id, s) AS k, concat(url, s) AS x FROM pages CROSS JOIN (VALUES {}) AS v(s)) AS t".format(", ".join(f"('{s}')" for s in SUFFIXES))
FAULTS = "(VALUES ('good', NULL), ('good', NULL), ('io', 'Io'), ('io', NULL), ('damaged', 'Io'), ('damaged', 'Truncated'), ('not', 'NotBzip2')) AS t(k, error)"


def sql(stage: Callable[[stages.Dialect, str], str], source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, views = stage(stages.SPARK, source), {}
        for name in ("nation", "region", "part", "documents", "pages"):
            if f"FROM {name}" in text:
                text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
                views[name] = table(spark, sf_dir, name)
        return spark.sql(text, **views)

    return run


def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers behind 0 to 79 zero bits and a name, found at every alignment."""
    shifts = F.explode(F.sequence(F.lit(0), F.lit(79))).alias("shift")

    @pandas_udf("binary")
    def hidden(names: pd.Series, by: pd.Series) -> pd.Series:
        out = []
        for name, n in zip(names, by, strict=True):
            data = name.encode()
            one, two = ((m.to_bytes(6, "big"), 48) for m in (block.BLOCK_MAGIC, block.END_MAGIC))
            out.append(block.joined([(bytes(10), int(n)), (data, 8 * len(data)), one, (data, 8 * len(data)), two])[0])
        return pd.Series(out, dtype=object)

    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name", shifts)
    files = rows.select((F.col("r_regionkey") * 100 + F.col("shift")).cast("long").alias("file_id"), hidden("r_name", "shift").alias("content"))
    return codec.markers(files).select("file_id", "kind", "bit")


def rle1_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    @pandas_udf("bigint")
    def coded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: int(runs.coded_lengths(runs.pieces(bytes(v))[1]).sum()))

    return table(spark, sf_dir, "documents").select("doc_id", coded(binary("text")).alias("coded_bytes"))


def block_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where blocks of level 1 end in files of some documents, and how full they are."""
    whole = few_documents(spark, sf_dir).select("file_id", one_after_another(F.col("parts"), "data").alias("content"))
    return codec.split_blocks(whole, 1).select("file_id", "block_no", "raw_length", "rle1_length")


def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_chunks(spark, sf_dir).select("source", "chunk_no", F.octet_length("raw").alias("n_bytes"))


def crc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), binary("p_name").alias("data"))
    return names.select("k", crc.crc_column(F.col("data")).alias("crc"))


def crc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's checksum over each brand's parts, in any order of rows: a sum of rotated checksums."""
    from pyspark.sql import Window as W

    names = table(spark, sf_dir, "part").select("p_brand", "p_partkey", codec.checksum(binary("p_name")).alias("crc"))
    after = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_partkey"))) - 1
    return names.withColumn("after", after).groupBy("p_brand").agg(crc.stream_crc(F.col("crc"), F.col("after")).alias("crc"), F.count("*").alias("blocks"))


def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, byte, n) of whole documents."""

    def run(batches):
        for batch in batches:
            counts = [np.bincount(np.frombuffer(data, np.uint8), minlength=256) for data in batch.column("data").to_pylist()]
            row, byte = np.nonzero(np.stack(counts)) if counts else (np.zeros(0, int),) * 2
            n = np.stack(counts)[row, byte] if counts else row
            keys = batch.select(["doc_id", "lang"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(byte, pa.int32()), pa.array(n, pa.int64())], ["doc_id", "lang", "byte", "n"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", binary("text").alias("data"))
    return docs.mapInArrow(run, "doc_id bigint, lang string, byte int, n bigint")


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_counts(spark, sf_dir).groupBy("lang", "byte").agg(F.sum("n").alias("n"))


def used_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_counts(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("used"), F.countDistinct(F.shiftright("byte", 4)).alias("map_rows"))


def huffman_kraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths for each document's bytes: they use up all codes, and none is longer than 17 bits."""

    @pandas_udf("array<int>")
    def lengths(values: pd.Series) -> pd.Series:
        def of(v):
            return huffman.code_lengths([*np.bincount(np.frombuffer(bytes(v), np.uint8), minlength=256).tolist(), 1])

        return values.map(of)

    docs = table(spark, sf_dir, "documents").select("doc_id", lengths(binary("text")).alias("lengths"))
    kraft = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftleft", F.lit(1).cast("long"), 17 - x))
    return docs.select("doc_id", (kraft == 1 << 17).alias("complete"), (F.array_max("lengths") <= 17).alias("short"))


def own_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names by brand, each brand one block of the engine's own sort, codes and bits, read by the C library."""

    @pandas_udf("binary")
    def own(values: pd.Series) -> pd.Series:
        return values.map(lambda v: block.assembled([block.encode_slowly(bytes(v))], 9))

    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", binary("p_name").alias("data")))).alias("parts"))
    packed = parts.select("p_brand", own(one_after_another(F.col("parts"), "data")).alias("packed"))
    got = packed.select("p_brand", codec.decompressed(F.col("packed")).alias("got"))
    return got.select("p_brand", F.octet_length("got.raw").alias("n_bytes"), F.md5("got.raw").alias("md5"))


def block_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.headers(codec.segments(multi_block_files(spark, sf_dir)))


def compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.octet_length(binary("text")).alias("before"), F.octet_length(codec.compressed(binary("text"))).alias("after"))
    sums = docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("before").alias("bytes_in"), F.sum("after").alias("bytes_out"))
    return sums.withColumn("line", report.summary(F.col("bytes_in"), F.col("bytes_out")))


#: Sizes with published report lines, and some more.
SIZES = ((98_696, 32_348), (212_340, 72_612), (0, 14), (5, 0), (1, 37), (120_244, 235), (300_000, 47))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    sizes = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}L, {b}L)" for a, b in SIZES) + " AS t(bytes_in, bytes_out)")
    return sizes.withColumn("line", report.summary(F.col("bytes_in"), F.col("bytes_out")))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.files import events_through_parts

    ship(spark)
    return events_through_parts(spark, sf_dir)


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compressed file written by the engine's sink and read by its source, in many tasks."""
    from ..sources.bz2blocks import through_files

    return through_files(table(spark, sf_dir, "lineitem"))


def variants_of(content: bytes) -> dict[str, bytes]:
    """A stream of a hundred kB or more, spoiled or with something behind it."""
    flipped = lambda at: content[:at] + bytes([content[at] ^ 0x10]) + content[at + 1 :]
    marker, end = (m.to_bytes(6, "big") + b"\0\0" for m in (block.BLOCK_MAGIC, block.END_MAGIC))
    return {
        "block checksum": flipped(12), "stream checksum": flipped(len(content) - 3), "cut": content[:-4], "header behind": content + b"BZh9", "no header": b"#" + content,
        "none": content, "garbage": content + b"garbage", "zeros": content + bytes(100), "marker": content + marker, "end marker": content + end, "twice": content + content,
    }


def through_source(wanted: str) -> Callable[[SparkSession, str], DataFrame]:
    """Files of several blocks and their variants, read by the data source in many tasks: the report, and how many bytes came out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.bz2blocks import read_files, write_files
        from .shared import new_folder

        names = re.findall(r"\('([a-z ]+)'", wanted)

        def spread(batches):
            for batch in batches:
                for file_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = variants_of(content)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{file_id}-{n}.bz2" for n in names]), pa.array([own[n] for n in names], pa.binary())], ["name", "content"])

        folder = new_folder(spark, "variants")
        write_files(multi_block_files(spark, sf_dir).select("file_id", "content").mapInArrow(spread, "name string, content binary"), folder)
        blocks, told = read_files(spark, folder, "PERMISSIVE", 64 << 10)
        sizes = blocks.groupBy("path").agg(F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"))
        name = F.element_at(F.split("path", "/"), -1)
        keys = (F.regexp_extract(name, r"^(\d+)-", 1).cast("long").alias("file_id"), F.regexp_extract(name, r"-([a-z ]+)\.", 1).alias("variant"))
        return told.join(sizes, "path", "left").select(*keys, "streams", "trailing", "error", "n_bytes")

    return run


def source_refuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_source(SPOILED)(spark, sf_dir).select("file_id", "variant", "error", "n_bytes")


def source_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_source(TAILED)(spark, sf_dir).select("file_id", "variant", "streams", "trailing", "n_bytes")


STAGES = {
    "rle1_runs": (stages.rle1_runs, SHORT),
    "bwt_column": (stages.bwt_column, SHORT),
    "bwt_origin": (stages.bwt_origin, SHORT),
    "least_rotation": (stages.least_rotation, SHORT),
    "exact_period": (stages.exact_period, SHORT),
    "mtf_positions": (stages.mtf_positions, SHORT),
    "zrle_symbols": (stages.zrle_symbols, SHORT),
    "symbol_histogram": (stages.symbol_histogram, SHORT),
    "table_count": (stages.table_count, COUNTS),
    "canonical_codes": (stages.canonical_codes, LENGTHS),
    "output_names": (stages.output_names, NAMES),
    "exit_codes": (stages.exit_codes, FAULTS),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "roundtrip_documents": round_trip("documents", ["doc_id"], "text"),
    "roundtrip_pages": round_trip("pages", ["page_id"], "html"),
    "roundtrip_conversations": round_trip("conversations", ["conv_id", "turn"], "text", 5),
    "roundtrip_levels": roundtrip_levels,
    "roundtrip_block_parallel": roundtrip_block_parallel,
    "concat_streams": concat_streams,
    "segment_decode": segment_decode,
    "false_markers": false_markers,
    "trailing_bytes": trailing_bytes,
    "refuse_damaged": refused(flip),
    "refuse_truncated": refused(cut_off),
    "refuse_not_bzip2": refused(not_bzip2),
    "verify_files": verify_files,
    "marker_scan": marker_scan,
    "rle1_length": rle1_length,
    "rle1_roundtrip": rle1_roundtrip,
    "block_boundaries": block_boundaries,
    "chunk_boundaries": chunk_boundaries,
    "crc_block": crc_block,
    "crc_stream": crc_stream,
    "byte_histogram": byte_histogram,
    "used_bytes": used_bytes,
    "inverse_bwt": inverse_bwt,
    "huffman_kraft": huffman_kraft,
    "own_encoder": own_encoder,
    "block_headers": block_headers,
    "compression_stats": compression_stats,
    "report_lines": report_lines,
    "stream_events": stream_events,
    "source_blocks": source_blocks,
    "source_refuses": source_refuses,
    "source_trailing": source_trailing,
} | {name: sql(*x) for name, x in STAGES.items()}

TABLE = "[" + ", ".join(map(str, crc.table())) + "]"
CRC = f"""xor(list_reduce([{crc.MASK}] || list_transform(range(0, CAST(length(hx) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS BIGINT)),
lambda a, b: xor((a << 8) & {crc.MASK}, {TABLE}[(xor(a >> 24, b) & 255) + 1])), {crc.MASK})"""
STREAMS = "SELECT source, hex(encode(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id))) AS hx FROM documents GROUP BY source"
PIECES = f"""WITH s AS ({STREAMS}), c AS (SELECT source, i AS chunk_no, substr(hx, 2 * {CHUNK} * i + 1, 2 * {CHUNK}) AS hx
FROM s, LATERAL (SELECT unnest(range(0, CAST(ceil(length(hx) / 2.0 / {CHUNK}) AS BIGINT))) AS i) e)"""
FILES = f"SELECT doc_id // {FEW} AS file_id, count(*) AS docs, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS x FROM documents GROUP BY 1"
SPOILED = "('block checksum', 'BlockCrcMismatch'), ('stream checksum', 'StreamCrcMismatch'), ('cut', 'Truncated'), ('header behind', 'Truncated'), ('no header', 'NotBzip2')"
TAILED = "('none', 1, false), ('garbage', 1, true), ('zeros', 1, true), ('marker', 1, true), ('end marker', 1, true), ('twice', 2, false)"
BYTES = """WITH h AS (SELECT doc_id, lang, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
d AS (SELECT doc_id, lang, unnest(l) AS hx, generate_subscripts(l, 1) AS i FROM h),
b AS (SELECT doc_id, lang, CAST(('0x' || hx) AS INT) AS byte, i FROM d)"""
#: The report lines of SIZES.
LINE = ", ".join(
    f"({a}, {b}, '{line}')"
    for (a, b), line in zip(
        SIZES,
        (
            " 3.051:1,  2.622 bits/byte, 67.22% saved, 98696 in, 32348 out.",
            " 2.924:1,  2.736 bits/byte, 65.80% saved, 212340 in, 72612 out.",
            " no data compressed.",
            " no data compressed.",
            " 0.027:1, 296.000 bits/byte, -3600.00% saved, 1 in, 37 out.",
            "511.677:1,  0.016 bits/byte, 99.80% saved, 120244 in, 235 out.",
            "6382.979:1,  0.001 bits/byte, 99.98% saved, 300000 in, 47 out.",
        ),
        strict=True,
    )
)

ORACLE_SQL: dict[str, str] = {
    "roundtrip_documents": "SELECT doc_id, text FROM documents",
    "roundtrip_pages": "SELECT page_id, html FROM pages",
    "roundtrip_conversations": "SELECT conv_id, turn, text FROM conversations",
    "roundtrip_levels": "SELECT CAST(lvl AS INT) AS lvl, n_nationkey, n_name, 'BZh' || lvl AS header FROM nation, range(1, 10) t(lvl)",
    "roundtrip_block_parallel": f"{PIECES} SELECT source, chunk_no, CAST(length(hx) / 2 AS BIGINT) AS n_bytes, md5(unhex(hx)) AS md5 FROM c",
    "chunk_boundaries": f"{PIECES} SELECT source, chunk_no, CAST(length(hx) / 2 AS INT) AS n_bytes FROM c",
    "concat_streams": f"SELECT file_id, CAST(docs AS INT) AS streams, CAST(strlen(x) AS INT) AS n_bytes, md5(x) AS md5 FROM ({FILES})",
    "segment_decode": f"SELECT file_id, 1 AS streams, false AS trailing, CAST(NULL AS VARCHAR) AS error, CAST(strlen(x) AS INT) AS n_bytes, md5(x) AS md5 FROM ({FILES})",
    "false_markers": f"SELECT file_id, CAST(NULL AS VARCHAR) AS error, CAST(strlen(x) AS INT) AS n_bytes, md5(x) AS md5 FROM ({FILES})",
    "trailing_bytes": "SELECT doc_id, variant, variant <> 'none' AS trailing, true AS ok FROM documents, (VALUES ('none'), ('garbage'), ('zero'), ('zeros'), ('header'), ('marker')) v(variant)",
    "refuse_damaged": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'StreamCrcMismatch' ELSE 'BlockCrcMismatch' END AS error, true AS refused FROM documents",
    "refuse_truncated": "SELECT doc_id, 'Truncated' AS error, true AS refused FROM documents",
    "refuse_not_bzip2": "SELECT doc_id, 'NotBzip2' AS error, true AS refused FROM documents",
    "source_refuses": f"SELECT file_id, variant, error, CAST(NULL AS BIGINT) AS n_bytes FROM ({FILES}), (VALUES {SPOILED}) v(variant, error)",
    "source_trailing": f"SELECT file_id, variant, streams, more AS trailing, CAST(streams * strlen(x) AS BIGINT) AS n_bytes FROM ({FILES}), (VALUES {TAILED}) v(variant, streams, more)",
    "verify_files": f"SELECT file_id, true AS ok, false AS trailing, 0 AS exit_code FROM ({FILES})",
    "marker_scan": """SELECT r_regionkey * 100 + s AS file_id, kind, CASE WHEN kind = 'block' THEN s + 8 * strlen(r_name) ELSE s + 16 * strlen(r_name) + 48 END AS bit
FROM region, range(0, 80) t(s), (VALUES ('block'), ('end')) v(kind)""",
    "rle1_length": f"""{BYTES}, m AS (SELECT doc_id, i, byte, CASE WHEN byte = lag(byte) OVER w THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m), r AS (SELECT doc_id, run, count(*) AS len FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, len // 255 * 5 + CASE WHEN len % 255 >= 4 THEN 5 ELSE len % 255 END AS coded FROM r)
SELECT doc_id, CAST(sum(coded) AS BIGINT) AS coded_bytes FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM documents WHERE coalesce(text, '') = ''""",
    "rle1_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "crc_block": f"SELECT k, {CRC} AS crc FROM (SELECT p_partkey AS k, hex(encode(p_name)) AS hx FROM part)",
    "crc_stream": f"""WITH c AS (SELECT p_brand, {CRC} AS crc, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) - 1) % 32 AS after
FROM (SELECT p_brand, p_partkey, hex(encode(p_name)) AS hx FROM part))
SELECT p_brand, bit_xor(((crc << after) & {crc.MASK}) | (crc >> (32 - after))) AS crc, count(*) AS blocks FROM c GROUP BY p_brand""",
    "byte_histogram": f"{BYTES} SELECT lang, byte, count(*) AS n FROM b GROUP BY lang, byte",
    "used_bytes": f"{BYTES} SELECT doc_id, count(DISTINCT byte) AS used, count(DISTINCT byte >> 4) AS map_rows FROM b GROUP BY doc_id",
    "inverse_bwt": f"SELECT k, x FROM {SHORT}",
    "huffman_kraft": "SELECT doc_id, true AS complete, true AS short FROM documents",
    "own_encoder": "SELECT p_brand, CAST(strlen(x) AS INT) AS n_bytes, md5(x) AS md5 FROM (SELECT p_brand, string_agg(p_name, '' ORDER BY p_partkey) AS x FROM part GROUP BY p_brand)",
    "report_lines": f"SELECT CAST(a AS BIGINT) AS bytes_in, CAST(b AS BIGINT) AS bytes_out, line FROM (VALUES {LINE}) t(a, b, line)",
    "stream_events": "SELECT event_id, user_id, event_type, props FROM events",
    "source_blocks": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem",
} | {name: stage(stages.DUCK, source) for name, (stage, source) in STAGES.items()}
