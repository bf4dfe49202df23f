"""Compression and decompression as DataFrame operators.

One block is one row. Payload crosses a shuffle at most once, to spread blocks over tasks; checks of streams run on rows
without payload. Every row carries (file_id, seq) or (file_id, block_no): order is never left to partitions. Errors are
values until a sink asks for `FAILFAST`.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import schemas
from ..functions import block, crc, runs, stream
from ..functions.errors import Damaged, checked_level
from ..plans.offsets import concatenated
from ..plans.shared import stored

#: Raw bytes of one output row; a block that expands to more gives several.
CHUNK_BYTES = 2 << 20


# Whole values in one column


def compressed(data: Column, level: int = 9) -> Column:
    """A binary column as one stream each; null stays null."""
    checked_level(level)

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bz2.compress(bytes(v), level))

    return run(data)


def decompressed(data: Column) -> Column:
    """A struct (raw, trailing, error, streams) for each value of a binary column; null gives null fields."""
    kind = T.StructType.fromDDL("raw binary, trailing boolean, error string, streams int")

    @pandas_udf(kind)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [None if v is None else stream.decompress(bytes(v)) for v in values]
        return pd.DataFrame(
            {
                "raw": [r and (None if r.error else r.raw) for r in rows],
                "trailing": pd.array([r and r.trailing for r in rows], "boolean"),
                "error": [r and r.error for r in rows],
                "streams": pd.array([r and r.streams for r in rows], "Int32"),
            }
        )

    return run(data)


def checksum(data: Column) -> Column:
    """The checksum of each value of a binary column."""

    @pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else crc.block_crc(bytes(v))).astype("Int64")

    return run(data)


# Splitting and encoding


def split_blocks(files: DataFrame, level: int = 9, block_bytes: int | None = None) -> DataFrame:
    """files (file_id, content) as raw blocks, cut where their coded runs fill a block: RAW_BLOCKS."""
    checked_level(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for no, (a, b, coded) in enumerate(runs.cuts(content or b"", level, block_bytes)):
                    yield pa.RecordBatch.from_pydict(
                        {"file_id": [file_id], "block_no": [no], "raw": [content[a:b]], "raw_length": pa.array([b - a], pa.int32()), "rle1_length": pa.array([coded], pa.int32())}
                    )

    return files.select("file_id", "content").mapInArrow(run, schemas.RAW_BLOCKS)


def encode_blocks(raw_blocks: DataFrame, level: int = 9) -> DataFrame:
    """Each raw block as bits of a stream: ENCODED_BLOCKS. Any task can do any block."""
    checked_level(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, no, raw in zip(*(batch.column(c).to_pylist() for c in ("file_id", "block_no", "raw")), strict=True):
                payload, bits, check = block.encode_chunk(raw, level)
                yield pa.RecordBatch.from_pydict(
                    {"file_id": [file_id], "block_no": [no], "payload": [payload], "bit_length": [bits], "byte_length": pa.array([len(payload)], pa.int32()), "crc": [check]}
                )

    spread = raw_blocks.select("file_id", "block_no", "raw").repartition("file_id", "block_no")
    return spread.mapInArrow(run, schemas.ENCODED_BLOCKS)


def assemble(encoded: DataFrame, level: int = 9) -> DataFrame:
    """(file_id, packed): one stream of each file's blocks in order. A file's packed bytes must fit into one row.

    For files beyond that, `single_streams` gives every block a stream of its own: streams may follow one another.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block_no", "payload", "bit_length", "crc")), strict=True))
        packed = block.assembled([r[1:] for r in rows], level)
        return pa.table({"file_id": [table.column("file_id")[0].as_py()], "packed": [packed]})

    return encoded.groupBy("file_id").applyInArrow(run, "file_id bigint, packed binary")


def single_streams(encoded: DataFrame, level: int = 9) -> DataFrame:
    """(file_id, block_no, packed): each block as a whole stream, to be written one behind the other."""

    @pandas_udf("binary")
    def whole(payload: pd.Series, bits: pd.Series, check: pd.Series) -> pd.Series:
        return pd.Series([block.assembled([(bytes(p), int(n), int(c))], level) for p, n, c in zip(payload, bits, check, strict=True)], dtype=object)

    return encoded.select("file_id", "block_no", whole("payload", "bit_length", "crc").alias("packed"))


# Markers, segments, decoding


def markers(files: DataFrame) -> DataFrame:
    """Every block and end marker of files (file_id, content) at any bit, false ones included: MARKERS.

    next_level: the level of the stream that starts behind an end marker, if one does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = block.markers(content or b"")
                after = [stream.header_level(content, bit + 87 >> 3) if kind == "end" else None for bit, kind in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "file_id": pa.array([file_id] * len(found), pa.int64()),
                        "bit": pa.array([b for b, _ in found], pa.int64()),
                        "kind": pa.array([k for _, k in found], pa.string()),
                        "next_level": pa.array(after, pa.int32()),
                    }
                )

    return files.select("file_id", "content").mapInArrow(run, schemas.MARKERS)


def segments(files: DataFrame) -> DataFrame:
    """Files cut at their markers, from the header on: SEGMENTS. The first segment has kind start; level is that of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = content or b""
                level, at = stream.header_level(content), 0
                stops = [(0, "start"), *block.markers(content), (8 * len(content), "")]
                for seq, ((bit, kind), (end, _)) in enumerate(zip(stops, stops[1:], strict=False)):
                    at = bit
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file_id": [file_id],
                            "seq": [seq],
                            "kind": [kind],
                            "start_bit": [at],
                            "first_bit": pa.array([at & 7], pa.int32()),
                            "bit_length": [end - at],
                            "level": pa.array([level], pa.int32()),
                            "bytes": pa.array([content[at >> 3 : end + 7 >> 3]], pa.binary()),
                        }
                    )
                    if kind == "end":
                        level = stream.header_level(content, bit + 87 >> 3) or level

    return files.select("file_id", "content").mapInArrow(run, schemas.SEGMENTS)


def split_segment(parts: DataFrame, file_id: int, seq: int, at_bit: int) -> DataFrame:
    """parts with one segment cut in two at a bit, as if a false marker stood there; later ones are renumbered."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = [row]
                if row["file_id"] == file_id and row["seq"] == seq and 0 < at_bit < row["bit_length"]:
                    start, whole = row["start_bit"], row["bytes"]
                    cut = row["first_bit"] + at_bit
                    rows = [
                        row | {"bit_length": at_bit, "bytes": whole[: cut + 7 >> 3]},
                        row | {"seq": seq + 1, "start_bit": start + at_bit, "first_bit": cut & 7, "bit_length": row["bit_length"] - at_bit, "bytes": whole[cut >> 3 :]},
                    ]
                elif row["file_id"] == file_id and row["seq"] > seq:
                    rows = [row | {"seq": row["seq"] + 1}]
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return parts.mapInArrow(run, schemas.SEGMENTS)


def decoded_rows(file_id: int, seq: int, start: int, bits: int, level: int | None, data: bytes, first_bit: int) -> list[dict]:
    """The rows of one block: its raw bytes in chunks, or its error."""
    base = {"file_id": file_id, "seq": seq, "kind": "block", "chunk_no": 0, "start_bit": start, "end_bit": start + bits, "level": level}
    empty = {"raw": None, "crc": None, "stored_crc": None, "block_length": None, "error": None}
    try:
        stored = block.Bits(data, first_bit + 48, first_bit + bits).take(32)
        raw = block.decode_block(data, first_bit, bits, level or 9)
    except Damaged as e:
        return [base | empty | {"error": e.name}]
    # Decoding has checked that the bytes have this checksum.
    whole = {"crc": stored, "stored_crc": stored, "block_length": runs.coded_length(raw), "error": None}
    return [base | whole | {"chunk_no": k, "raw": raw[a : a + CHUNK_BYTES]} for k, a in enumerate(range(0, len(raw), CHUNK_BYTES))]


DECODED = pa.schema(
    [
        ("file_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("chunk_no", pa.int32()), ("start_bit", pa.int64()),
        ("end_bit", pa.int64()), ("level", pa.int32()), ("raw", pa.binary()), ("crc", pa.int64()), ("stored_crc", pa.int64()),
        ("block_length", pa.int32()), ("error", pa.string()),
    ]
)


def decode_segments(parts: DataFrame) -> DataFrame:
    """Each segment decoded alone: DECODED_BLOCKS. End segments carry the stream's checksum as stored_crc; start segments and what
    can't be decoded carry no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["file_id"], row["seq"], row["start_bit"], row["bit_length"], row["level"])
                if row["kind"] == "block":
                    rows = decoded_rows(*key, row["bytes"], row["first_bit"])
                else:
                    stored = None
                    if row["kind"] == "end" and row["bit_length"] >= 80:
                        stored = block.Bits(row["bytes"], row["first_bit"] + 48).take(32)
                    rows = [
                        {"file_id": key[0], "seq": key[1], "kind": row["kind"], "chunk_no": 0, "start_bit": key[2], "end_bit": key[2] + key[3], "level": key[4], "stored_crc": stored}
                    ]
                yield pa.RecordBatch.from_pylist(rows, DECODED)

    spread = parts.repartition("file_id", "seq")
    return spread.mapInArrow(run, schemas.DECODED_BLOCKS)


def repair(decoded: DataFrame, parts: DataFrame) -> DataFrame:
    """decoded, with blocks that a false marker cut joined again.

    A block that failed is tried together with 1, 2, 4, ... segments that follow, up to the largest compressed block. Only
    files with a failure are looked at again; what no joining mends keeps its error.
    """
    broken = decoded.where("error is not null").select("file_id").distinct()
    if broken.isEmpty():
        return decoded

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        out, at = [], 0
        while at < len(rows):
            row = rows[at]
            if row["kind"] != "block":
                stored = block.Bits(row["bytes"], row["first_bit"] + 48).take(32) if row["kind"] == "end" and row["bit_length"] >= 80 else None
                if row["kind"] in ("start", "end"):
                    out.append({"file_id": row["file_id"], "seq": row["seq"], "kind": row["kind"], "chunk_no": 0, "start_bit": row["start_bit"], "end_bit": row["start_bit"] + row["bit_length"], "level": row["level"], "stored_crc": stored})
                at += 1
                continue
            take, first = 1, None
            while True:
                own = rows[at : at + take]
                data, bits = block.joined([(block.shifted(r["bytes"], r["first_bit"], r["bit_length"]), r["bit_length"]) for r in own])
                got = decoded_rows(row["file_id"], row["seq"], row["start_bit"], bits, row["level"], data, 0)
                first = first or got
                if got[0]["error"] is None or at + take >= len(rows) or bits > 8 * block.MOST_COMPRESSED:
                    break
                take *= 2
            if got[0]["error"] is None:
                end = row["start_bit"] + block.decode_slowly(data, 0, bits, row["level"])[3] if take > 1 else row["start_bit"] + bits
                out += [g | {"end_bit": end} for g in got]
                at += 1
                while at < len(rows) and rows[at]["start_bit"] < end:
                    at += 1
            else:
                out += first
                at += 1
        return pa.Table.from_pylist(out, DECODED)

    again = parts.join(broken, "file_id", "left_semi").groupBy("file_id").applyInArrow(run, schemas.DECODED_BLOCKS)
    return decoded.join(broken, "file_id", "left_anti").unionByName(again)


def check_streams(decoded: DataFrame) -> DataFrame:
    """STREAM_REPORT: each file's streams in order, from rows without payload.

    Checks that blocks follow one another without a gap, that checksums of blocks and streams agree, and what follows the last stream.
    """
    light = decoded.withColumn("bytes", F.coalesce(F.octet_length("raw"), F.lit(0))).drop("raw")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "chunk_no"])
        file_id, error, streams, blocks, state, at, opened = rows["file_id"].iloc[0], None, 0, 0, 0, 32, False
        out, end = 0, int(rows["end_bit"].max())
        opened = pd.notna(rows["level"].iloc[0])
        if not opened:
            error = "NotBzip2"
        for r in rows.itertuples() if opened else ():
            if r.kind == "start" or r.start_bit < at and r.chunk_no == 0:
                continue
            if r.kind == "block":
                if r.chunk_no == 0:
                    if not opened:
                        break
                    error = r.error if r.start_bit == at else "BadBlockMagic"
                    if error is None and r.crc != r.stored_crc:
                        error = "BlockCrcMismatch"
                    if error:
                        break
                    state, blocks, at = crc.combine(state, int(r.stored_crc)), blocks + 1, int(r.end_bit)
                out += r.bytes
            else:
                if not opened:
                    break
                if pd.isna(r.stored_crc):
                    error = "Truncated"
                elif r.start_bit != at:
                    error = "BadBlockMagic"
                elif int(r.stored_crc) != state:
                    error = "StreamCrcMismatch"
                if error:
                    break
                streams, state = streams + 1, 0
                at = (int(r.start_bit) + 87) // 8 * 8
                opened = r.end_bit >= at + 32 and r.opens
                at += 32 if opened else 0
        if not error and opened:
            error = "Truncated"
        trailing = not error and at < end
        return pd.DataFrame(
            {"file_id": [file_id], "streams": [streams], "blocks": [blocks], "bytes_out": [out], "trailing": [bool(trailing)], "error": [error], "exit_code": [2 if error else 0]}
        )

    return light.groupBy("file_id").applyInPandas(run, schemas.STREAM_REPORT)


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, report) of files (file_id, content): DECODED_BLOCKS in their file's order by (seq, chunk_no), and STREAM_REPORT."""
    parts = segments(files)
    # Read several times below.
    decoded = repair(stored(decode_segments(parts), "decoded"), parts)
    return decoded, check_streams(with_openings(decoded, parts))


def with_openings(decoded: DataFrame, parts: DataFrame) -> DataFrame:
    """decoded with a column `opens`: whether a stream header stands behind an end segment's checksum."""

    @pandas_udf("boolean")
    def opens(data: pd.Series, first: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([k == "end" and stream.header_level(bytes(d), f + 87 >> 3) is not None for d, f, k in zip(data, first, kind, strict=True)])

    ends = parts.where("kind = 'end'").select("file_id", "seq", opens("bytes", "first_bit", "kind").alias("opens"))
    return decoded.join(ends, ["file_id", "seq"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))


def whole_files(decoded: DataFrame, report: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """(file_id, raw, error): each file's bytes in order, null where the report has an error; with FAILFAST that raises.

    A file's raw bytes must fit into one row; larger ones are read as decoded blocks.
    """
    pieces = F.array_sort(F.collect_list(F.struct("seq", "chunk_no", "raw")))
    raw = decoded.where("kind = 'block'").groupBy("file_id").agg(pieces.alias("pieces"))
    joined = report.select("file_id", "error").join(raw, "file_id", "left")
    data = concatenated(F.coalesce("pieces", F.array().cast("array<struct<seq:bigint,chunk_no:int,raw:binary>>")), lambda x: x["raw"])
    good = F.col("error").isNull()
    bad = F.raise_error(F.concat(F.lit("damaged: "), F.col("error"))).cast("binary") if mode == "FAILFAST" else F.lit(None).cast("binary")
    return joined.select("file_id", F.when(good, data).otherwise(bad).alias("raw"), "error")


def headers(parts: DataFrame) -> DataFrame:
    """HEADERS: what stands before each block's symbols. Damaged headers give no row."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    h = block.read_header(block.Bits(row["bytes"], row["first_bit"], row["first_bit"] + row["bit_length"]), row["level"] or 9)
                except Damaged:
                    continue
                rows.append((row["file_id"], row["seq"], h.crc, h.randomized, h.origin, len(h.used), h.groups, len(h.selectors), max(map(max, h.lengths))))
            names = ["file_id", "seq", "crc", "randomized", "origin", "used", "groups", "selectors", "longest_code"]
            kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return parts.where("kind = 'block'").mapInArrow(run, schemas.HEADERS)
