"""Streams of files keep empty lines."""

import bz2

from blockloom.streaming.files import pack_stream, unpack_stream


def test_empty_lines_stay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, text in (("a", "x\n\ny\n\n\n"), ("b", ""), ("c", "\n"), ("d", "\nlast")):
        (source / f"{name}.bz2").write_bytes(bz2.compress(text.encode()))
    unpack_stream(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    got = [r["line"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(["x", "", "y", "", "", "", "", "last"])


def test_packed_empty_rows_come_back(spark, tmp_path):
    rows = ["", "a", "", "b", ""]
    spark.createDataFrame([(r,) for r in rows], "line string").repartition(3).write.text(f"{tmp_path}/rows")
    lines = spark.readStream.text(f"{tmp_path}/rows").toDF("line")
    pack_stream(lines, f"{tmp_path}/packed", f"{tmp_path}/c1").awaitTermination()
    unpack_stream(spark, f"{tmp_path}/packed", f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert sorted(r["line"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(rows)
