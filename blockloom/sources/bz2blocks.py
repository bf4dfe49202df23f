"""A data source for bzip2 files: one file decodes in many tasks, and tasks write blocks side by side.

    blocks, report = read_files(spark, path)                                     # blocks: path, start_bit, chunk_no, raw; checked
    spark.dataSource.register(Bz2Blocks)
    spark.read.format("bz2blocks").option("range_bytes", 4 << 20).load(path)     # FOUND: every marker, blocks decoded, not checked
    df.write.format("bz2blocks").option("level", 9).mode("append").save(folder)  # df: one column of bytes or text, a row a line

A task takes the markers that start in its range of bytes and reads as much behind the range as its last block needs. A marker at which no
block can be decoded is a row with an error: it may be a false one, inside a block that began in a range before. `check_files` walks each
file's rows without their bytes, from the header on: which markers are true, whether stream checksums agree, what is behind the last
stream. `read_files` first walks the markers without decoding anything; if every stream's checksum agrees so, all are true, and blocks
are decoded once. Paths are those that pyarrow's file systems know. The writer cuts blocks behind rows, so every block holds whole lines; files
appear under their names when all tasks are done, and vanish when one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import block, runs
from ..functions.crc import combine
from ..functions.errors import Damaged
from ..functions.stream import header_level

RANGE_BYTES = 4 << 20
CHUNK_BYTES = 2 << 20
#: The reports of at most so many files go to every task; more are joined by a shuffle.
FEW_FILES = 50_000

#: kind: start (end_bit: the file's), block or end; crc: as stored; opens: the level of the stream that starts there or behind an end.
FOUND = "path string, kind string, start_bit bigint, end_bit bigint, chunk_no int, raw binary, crc bigint, opens int, error string"
#: last_bit: where the last whole stream ends; false_bits: markers before that which are none.
FILES = "path string, streams int, blocks bigint, trailing boolean, last_bit bigint, false_bits array<bigint>, error string"


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return fs.FileSystem.from_uri(f"{scheme}://{'/' + rest.lstrip('/') if scheme == 'file' else rest.lstrip('/')}")
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, decode: bool):
        self.path, self.range_bytes, self.decode = path, range_bytes, decode

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".bz2") and not f.base_name.startswith(("_", "."))]
        return [
            Range(f.path, a, min(a + self.range_bytes, f.size), f.size)
            for f in sorted(found, key=lambda f: f.path)
            for a in range(0, max(1, f.size), self.range_bytes)
        ]

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as file:
            file.seek(part.first)
            data = file.read(min(part.size, part.last + block.MOST_COMPRESSED + 16) - part.first)
        base = 8 * part.first
        if part.first == 0:
            level = header_level(data)
            short = len(data) < 4 and data and b"BZh".startswith(data[:3])
            yield part.path, "start", 0, 8 * part.size, 0, None, None, level, None if level else "Truncated" if short else "NotBzip2"
        found = block.markers(data)
        stops = sorted({b for b, _ in found} | {8 * len(data)})
        done = 0
        for bit, kind in found:
            if not part.first <= part.first + (bit >> 3) < part.last or bit < done:
                continue
            crc = block.Bits(data, bit + 48).take(32) if bit + 80 <= 8 * len(data) else None
            if kind == "end":
                yield part.path, kind, base + bit, base + bit + 80, 0, None, crc, header_level(data, bit + 87 >> 3), None
                continue
            ahead = [s for s in stops if s > bit]
            if not self.decode:
                yield part.path, kind, base + bit, base + ahead[0], 0, None, crc, None, None
                continue
            raw, stop, error = decoded(data, bit, ahead)
            if error:
                yield part.path, kind, base + bit, base + ahead[0], 0, None, crc, None, error
                continue
            done = stop
            for no, a in enumerate(range(0, len(raw), CHUNK_BYTES)):
                yield part.path, kind, base + bit, base + stop, no, raw[a : a + CHUNK_BYTES], crc, None, None


def decoded(data: bytes, bit: int, ahead: list[int]) -> tuple[bytes, int, str | None]:
    """(raw bytes, end, error) of the block at a bit: it ends at one of the places ahead, as those before may be false markers."""
    k, error = 1, "Truncated"
    while True:
        stop = ahead[min(k, len(ahead)) - 1]
        try:
            raw = block.decode_block(data, bit, stop - bit, 9)
            if k > 1 or stop == 8 * len(data):
                stop = block.decode_slowly(data, bit, stop, 9)[3]
            return raw, stop, None
        except Damaged as e:
            error = e.name
        if k >= len(ahead) or stop - bit > 8 * block.MOST_COMPRESSED:
            return b"", ahead[0], error
        k *= 2


def walked(rows: pd.DataFrame) -> pd.DataFrame:
    """FILES of one file's rows: one for each marker."""
    rows = rows.sort_values("start_bit", kind="stable")
    first = rows.iloc[0]
    size, error, at, state, streams, blocks, false = int(first["end_bit"]), first["error"], 32, 0, 0, 0, []
    last, open_ = 0, not isinstance(error, str)
    error = error if isinstance(error, str) else None
    for r in rows.iloc[1:].itertuples():
        if not open_ or error:
            break
        if r.start_bit < at:
            false.append(int(r.start_bit))
            continue
        if r.start_bit > at:
            error = "BadBlockMagic"
        elif r.kind == "block":
            error = r.error if isinstance(r.error, str) else "Truncated" if pd.isna(r.crc) else None
            if not error:
                state, blocks, at = combine(state, int(r.crc)), blocks + 1, int(r.end_bit)
        elif pd.isna(r.crc):
            error = "Truncated"
        elif int(r.crc) != state:
            error = "StreamCrcMismatch"
        else:
            streams, state, last = streams + 1, 0, (at + 87) // 8 * 8
            open_, at = not pd.isna(r.opens), last + 32
    if open_ and not error:
        error = "Truncated" if at + 48 > size else "BadBlockMagic"
    return pd.DataFrame(
        {"path": [first["path"]], "streams": [streams], "blocks": [blocks], "trailing": [not error and last < size], "last_bit": [last], "false_bits": [false], "error": [error]}
    )


def check_files(found: DataFrame) -> DataFrame:
    """FILES: a row for each file of FOUND, read without the bytes."""
    light = found.where("chunk_no = 0").select("path", "kind", "start_bit", "end_bit", "crc", "opens", "error")
    return light.groupBy("path").applyInPandas(walked, FILES)


def read_files(spark: SparkSession, path: str, mode: str = "FAILFAST", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(blocks, report) of a file or a folder's .bz2 files: blocks has path, start_bit, chunk_no and raw, report FILES.

    FAILFAST: raises a damaged file's error, here or where a block is read. PERMISSIVE: damaged files have no blocks; for their errors
    all blocks are decoded once more.
    """
    spark.dataSource.register(Bz2Blocks)
    load = lambda decode: spark.read.format("bz2blocks").option("range_bytes", range_bytes).option("decode", decode).load(path)
    bad = None
    if mode == "FAILFAST":
        report = kept(check_files(load("false")))
        bad = report.where("error is not null").first()
    if mode != "FAILFAST" or bad:
        report = kept(check_files(load("true")))
        bad = report.where("error is not null").first()
    if mode == "FAILFAST" and bad:
        raise ValueError(f"damaged: {bad['error']}: {bad['path']}")
    blocks = load("true").where("kind = 'block'").withColumnRenamed("error", "own")
    # Of most files every marker is true and nothing is left out.
    special = report.where("error is not null or trailing or size(false_bits) > 0").select("path", "last_bit", "false_bits", "error")
    few = special.limit(FEW_FILES + 1).count()
    if few:
        blocks = blocks.join(F.broadcast(special) if few <= FEW_FILES else special, "path", "left")
        blocks = blocks.where("last_bit is null or error is null and start_bit < last_bit and not array_contains(false_bits, start_bit)")
    raw = F.when(F.col("own").isNotNull(), F.raise_error(F.concat(F.lit("damaged: "), "own")).cast("binary")).otherwise(F.col("raw"))
    return blocks.select("path", "start_bit", "chunk_no", raw.alias("raw")), report


def kept(report: DataFrame) -> DataFrame:
    from ..plans.shared import new_folder

    spark, folder = report.sparkSession, new_folder(report.sparkSession, "bz2-report")
    report.write.parquet(folder)
    return spark.read.schema(report.schema).parquet(folder)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class Writer(DataSourceWriter):
    def __init__(self, folder: str, level: int):
        self.folder, self.level, self.run = folder, level, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}.bz2"
        target = f"{folder}/_{name}.{context.taskAttemptId()}"
        limit, held, size, blocks = runs.safe_chunk(self.level), [], 0, []

        def flush():
            nonlocal held, size
            raw = b"".join(held)
            for a in range(0, len(raw), limit):
                blocks.append(block.encode_chunk(raw[a : a + limit], self.level))
            held, size = [], 0

        with system.open_output_stream(target, compression=None) as out:
            for row in rows:
                value = row[0]
                line = (value.encode() if isinstance(value, str) else bytes(value or b"")) + b"\n"
                if held and size + len(line) > limit:
                    flush()
                held.append(line)
                size += len(line)
                if len(blocks) >= 16:  # streams may follow one another
                    out.write(block.assembled(blocks, self.level))
                    blocks = []
            if held:
                flush()
            out.write(block.assembled(blocks, self.level))
        return Written(target, f"{folder}/{name}")

    def commit(self, messages: list[Written]) -> None:
        system, _ = opened(self.folder)
        for m in messages:
            system.move(m.temporary, m.final)

    def abort(self, messages: list[Written]) -> None:
        system, _ = opened(self.folder)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class Bz2Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bz2blocks"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("decode", "true") == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("level", 9)))


def write_files(files: DataFrame, folder: str) -> None:
    """files (name, content) as files of a folder; written again, a file stays the same."""

    def run(batches):
        system, target = opened(folder)
        system.create_dir(target, recursive=True)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_output_stream(f"{target}/{name}", compression=None) as out:
                    out.write(content)
            yield batch.select(["name"])

    files.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def through_files(lineitem: DataFrame) -> DataFrame:
    """lineitem as lines of text, written as bzip2 files and read again."""
    from ..plans.shared import new_folder

    spark = lineitem.sparkSession
    spark.dataSource.register(Bz2Blocks)
    folder = new_folder(spark, "bz2")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    lines = lineitem.select(F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("line"))
    lines.write.format("bz2blocks").option("level", 1).mode("append").save(folder)
    blocks, _ = read_files(spark, folder)
    back = blocks.select(F.explode(F.split(F.rtrim(F.decode("raw", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
    parts = F.split("line", ",")
    kinds = [lineitem.schema[c].dataType for c in columns]
    return back.select(*[parts[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))])
