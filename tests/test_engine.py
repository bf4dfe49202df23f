"""The DataFrame operators, data source, streaming and command."""

import bz2
import io
import os
import sys

import pytest

from blockloom import cli
from blockloom.functions import crc
from blockloom.operators import codec
from tests.test_kernels import SAMPLES, lines, noise


def files(spark, contents):
    return spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id bigint, content binary")


def decoded(spark, contents):
    blocks, told = codec.decode_files(files(spark, contents))
    report = {r["file_id"]: r for r in told.collect()}
    raw = {r["file_id"]: r["raw"] for r in codec.whole_files(blocks, told).collect()}
    return report, raw


@pytest.mark.parametrize("level", [1, 9])
def test_blocks_of_files(spark, level):
    contents = list(SAMPLES.values())
    raw = files(spark, contents)
    packed = codec.assemble(codec.encode_blocks(codec.split_blocks(raw, level), level), level).collect()
    got = {r["file_id"]: bytes(r["packed"]) for r in packed}
    for i, c in enumerate(contents):
        if c:
            assert bz2.decompress(got[i]) == c
    report, back = decoded(spark, [got.get(i, bz2.compress(b"")) for i in range(len(contents))])
    for i, c in enumerate(contents):
        assert report[i]["error"] is None and report[i]["streams"] == 1 and not report[i]["trailing"] and report[i]["bytes_out"] == len(c)
        assert bytes(back[i]) == c


def test_streams_in_a_row_and_damage(spark):
    first, second = bz2.compress(lines(20_000), 1), bz2.compress(noise(150_000, 3), 9)
    spoiled = bytearray(first)
    spoiled[len(first) // 2] ^= 16
    contents = [first + second, first + b"garbage", bytes(spoiled), first[: len(first) // 2], b"plain", b"", second + b"BZh9", first[:-4] + b"\1\2\3\4"]
    report, raw = decoded(spark, contents)
    assert bytes(raw[0]) == lines(20_000) + noise(150_000, 3) and report[0]["streams"] == 2
    assert report[1]["trailing"] and report[1]["exit_code"] == 0 and bytes(raw[1]) == lines(20_000)
    assert [report[i]["error"] for i in (4, 5, 6)] == ["NotBzip2", "NotBzip2", "Truncated"]
    assert all(report[i]["error"] and report[i]["exit_code"] == 2 and raw[i] is None for i in (2, 3, 7))


@pytest.mark.parametrize("at", [1, 7, 48, 12_345])
def test_false_markers_are_repaired(spark, at):
    data = lines(20_000)
    parts = codec.segments(files(spark, [bz2.compress(data, 1)]))
    parts = codec.split_segment(parts, 0, 1, at)
    got = codec.repair(codec.decode_segments(parts), parts)
    told = codec.check_streams(codec.with_openings(got, parts))
    assert told.collect()[0]["error"] is None
    assert bytes(codec.whole_files(got, told).collect()[0]["raw"]) == data


def test_large_expansion_gives_chunks(spark):
    data = bytes(6_000_000) + b"x" * 1000 + b"\7" * 6_000_000
    blocks, told = codec.decode_files(files(spark, [bz2.compress(data)]))
    assert blocks.where("kind = 'block'").count() > 1
    assert bytes(codec.whole_files(blocks, told).collect()[0]["raw"]) == data


def test_failfast_raises(spark):
    blocks, told = codec.decode_files(files(spark, [b"plain"]))
    with pytest.raises(Exception, match="NotBzip2"):
        codec.whole_files(blocks, told, "FAILFAST").collect()


def test_native_checksum(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (bytearray(bytes(range(256))),)], "data binary")
    got = rows.select("data", crc.crc_column(F.col("data")).alias("native"), codec.checksum(F.col("data")).alias("kernel")).collect()
    assert all(r["native"] == r["kernel"] == crc.block_crc(bytes(r["data"])) for r in got)


def test_null_values(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), (bytearray(b""),)], "data binary").select(codec.compressed(F.col("data")).alias("p"))
    got = rows.select("p", codec.decompressed(F.col("p")).alias("d")).collect()
    assert [r["p"] is None for r in got] == [True, False]
    assert got[0]["d"]["raw"] is None and bytes(got[1]["d"]["raw"]) == b""


def test_source_reads_one_file_in_many_tasks(spark, tmp_path):
    from blockloom.sources.bz2blocks import read_files

    data = lines(60_000)
    (tmp_path / "a.bz2").write_bytes(bz2.compress(data, 1))
    for size in (4_000, 50_000):
        got, told = read_files(spark, str(tmp_path / "a.bz2"), range_bytes=size)
        assert got.rdd.getNumPartitions() > 3
        assert b"".join(bytes(r["raw"]) for r in sorted(got.collect(), key=lambda r: (r["start_bit"], r["chunk_no"]))) == data
        assert [(r["streams"], r["trailing"], r["error"]) for r in told.collect()] == [(1, False, None)]
    (tmp_path / "b.bz2").write_bytes(b"no stream")
    with pytest.raises(Exception, match="NotBzip2"):
        read_files(spark, str(tmp_path / "b.bz2"))[0].collect()


@pytest.mark.parametrize("mode", ["FAILFAST", "PERMISSIVE"])
def test_source_checks_streams(spark, tmp_path, mode):
    from blockloom.sources.bz2blocks import read_files

    data, more = lines(9_000), noise(9_000, 5)
    packed, magic = bz2.compress(data, 1), bytes.fromhex("314159265359")
    spoil = lambda at: packed[:at] + bytes([packed[at] ^ 4]) + packed[at + 1 :]
    cases = {
        "sum": (spoil(len(packed) - 4), "StreamCrcMismatch"), "cut": (packed[:-4], "Truncated"), "half": (packed[: len(packed) // 2], "Truncated"), "block": (spoil(11), "BlockCrcMismatch"),
        "empty": (b"", "NotBzip2"), "bz": (b"BZ", "Truncated"), "head": (b"BZh9", "Truncated"), "other": (b"BZh9" + bytes(20), "BadBlockMagic"), "next": (packed + b"BZh9", "Truncated"),
        "marker": (packed + magic + b"\0\0", None), "garbage": (packed + b"garbage", None), "two": (packed + bz2.compress(more, 9), None), "none": (bz2.compress(b""), None),
    }
    want = {"marker": data, "garbage": data, "two": data + more, "none": b""}
    for name, (content, error) in cases.items():
        (tmp_path / f"{name}.bz2").write_bytes(content)
    if mode == "PERMISSIVE":
        blocks, told = read_files(spark, str(tmp_path), mode, 5_000)
        report = {os.path.basename(r["path"]).removesuffix(".bz2"): r for r in told.collect()}
        assert {n: r["error"] for n, r in report.items()} == {n: e for n, (_, e) in cases.items()}
        assert {n for n, r in report.items() if r["trailing"]} == {"marker", "garbage"} and report["two"]["streams"] == 2
        rows = blocks.collect()
        for name in cases:
            own = sorted((r["start_bit"], r["chunk_no"], bytes(r["raw"])) for r in rows if r["path"].endswith(f"/{name}.bz2"))
            assert b"".join(x[2] for x in own) == want.get(name, b"")
    else:
        for name, (_, error) in cases.items():
            if error:
                with pytest.raises(Exception, match=error):
                    read_files(spark, str(tmp_path / f"{name}.bz2"), mode, 5_000)[0].collect()
            else:
                blocks, _ = read_files(spark, str(tmp_path / f"{name}.bz2"), mode, 5_000)
                assert b"".join(bytes(r["raw"]) for r in sorted(blocks.collect(), key=lambda r: r["start_bit"])) == want[name]


def test_false_markers_in_another_range_are_candidates_only():
    import pandas as pd

    from blockloom.functions.crc import combine
    from blockloom.sources.bz2blocks import walked

    rows = [("f", "start", 0, 8_000, None, 9, None), ("f", "block", 32, 3_000, 7, None, None), ("f", "block", 1_000, 2_000, 5, None, "BadHuffmanCode"), ("f", "block", 3_000, 5_000, 9, None, None)]
    rows += [("f", "end", 5_000, 5_080, combine(combine(0, 7), 9), None, None), ("f", "block", 6_000, 8_000, 3, None, "Truncated")]
    names = ["path", "kind", "start_bit", "end_bit", "crc", "opens", "error"]
    got = walked(pd.DataFrame(rows[::-1], columns=names)).iloc[0]
    assert (got["error"], got["streams"], got["blocks"], got["false_bits"], got["last_bit"], got["trailing"]) == (None, 1, 2, [1_000], 5_080, True)


def test_sink_writes_files_any_tool_reads(spark, tmp_path):
    from blockloom.sources.bz2blocks import Bz2Blocks

    spark.dataSource.register(Bz2Blocks)
    rows = spark.range(5000).selectExpr("concat('row ', id) AS line").repartition(3)
    rows.write.format("bz2blocks").option("level", 1).mode("append").save(str(tmp_path / "out"))
    names = os.listdir(tmp_path / "out")
    assert len(names) == 3 and all(n.endswith(".bz2") and not n.startswith("_") for n in names)
    text = b"".join(bz2.decompress((tmp_path / "out" / n).read_bytes()) for n in names)
    assert sorted(text.decode().split("\n")[:-1]) == sorted(f"row {i}" for i in range(5000))


def test_lines_are_packed_as_they_come(spark, tmp_path):
    from blockloom.streaming.files import pack_stream

    lines_in = [f"line {i} " + "x" * (i % 50) for i in range(9_000)] + ["", ""]
    spark.createDataFrame([(x,) for x in lines_in], "line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("line string").parquet(str(tmp_path / "in"))
    pack_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"), 1).awaitTermination()
    got = [bytes(r["packed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    back = [bz2.decompress(p).decode() for p in got]
    assert len(got) > 3 and max(map(len, back)) <= 100_000
    assert sorted(x for b in back for x in b.split("\n")[:-1]) == sorted(lines_in)


def test_streaming_directory(spark, tmp_path):
    from blockloom.streaming.files import unpack_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bz2").write_bytes(bz2.compress(f"a{k}\nb{k}\n".encode()))
    unpack_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1).awaitTermination()
    got = {r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"{x}{k}" for x in "ab" for k in range(3)}
    (tmp_path / "in" / "bad.bz2").write_bytes(b"no stream")
    with pytest.raises(Exception, match="NotBzip2"):
        unpack_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1).awaitTermination()


# The command


def test_command_round_trip(tmp_path):
    name = tmp_path / "a.txt"
    name.write_bytes(lines(40_000))
    os.utime(name, (1_000_000, 1_000_000))
    assert cli.main(["-1", "-n", "2", str(name)]) == 0
    packed = tmp_path / "a.txt.bz2"
    assert not name.exists() and packed.read_bytes()[:4] == b"BZh1" and packed.stat().st_mtime == 1_000_000
    assert cli.main(["-t", str(packed)]) == 0
    assert cli.main(["-dk", str(packed)]) == 0 and name.read_bytes() == lines(40_000) and packed.exists()
    assert cli.main(["-d", str(packed)]) == 1, "the target is there already"
    assert cli.main(["-df", str(packed)]) == 0 and not packed.exists()


def test_command_exit_codes(tmp_path, capsys):
    bad = tmp_path / "bad.bz2"
    bad.write_bytes(bz2.compress(b"x" * 100)[:-3])
    good = tmp_path / "good.bz2"
    good.write_bytes(bz2.compress(b"fine") + b"tail")
    assert cli.main(["-t", str(bad)]) == 2
    assert cli.main(["-t", str(tmp_path / "none.bz2")]) == 1
    assert cli.main(["-tk", str(tmp_path / "none"), str(bad), str(good)]) == 2
    assert "trailing" in capsys.readouterr().err
    assert cli.main([str(good)]) == cli.main(["-c", str(good)]) == 1 and cli.main(["--nonsense"]) == 1 and cli.main([str(tmp_path)]) == 1


def test_command_streams(monkeypatch, capsysbinary):
    class In:
        buffer = io.BytesIO(b"some text")

        @staticmethod
        def isatty():
            return False

    monkeypatch.setattr(sys, "stdin", In)
    assert cli.main(["-c"]) == 0
    assert bz2.decompress(capsysbinary.readouterr().out) == b"some text"


def test_names_and_summaries():
    assert [cli.unpacked_name(n)[0] for n in ("a.bz2", "a.bz", "a.tbz2", "a.tbz", "a.x")] == ["a", "a", "a.tar", "a.tar", "a.x.out"]
    assert cli.summary(98_696, 32_348) == " 3.051:1,  2.622 bits/byte, 67.22% saved, 98696 in, 32348 out."
    assert cli.summary(0, 14) == cli.summary(5, 0) == " no data compressed."
    assert cli.arguments([], "BUNZIP2").mode == "d" and cli.arguments([], "/bin/BZCAT").stdout is True
    assert cli.unpacked_name("x/.bz2") == ("x/.bz2.out", False)
    assert cli.arguments([], "bunzip2").mode == "d" and cli.arguments([], "bzcat").stdout is True
    assert cli.arguments(["-3", "-7"]).level == 7
