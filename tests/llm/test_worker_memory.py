"""What goes to Python workers at a time, and what they keep between tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import _bytes, _shared

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["held", "bytes"])


def test_long_texts_come_in_batches_bounded_in_bytes(spark):
    docs = spark.range(3_000, numPartitions=1).select("id", F.repeat(F.lit("ten bytes "), 1_000).alias("text"))
    got = _shared.written(docs.mapInArrow(sizes, "held bigint, bytes bigint"), "batch-sizes")
    rows = got.collect()
    _shared.dropped(got)
    assert sum(r["held"] for r in rows) == 3_000
    assert max(r["bytes"] for r in rows) <= 2 * _shared.BATCH_BYTES
    assert spark.conf.get(KEY, None) is None


def test_a_session_that_says_how_many_bytes_is_left_alone(spark):
    spark.conf.set(KEY, "1000000")
    try:
        with _shared.small_batches(spark):
            assert spark.conf.get(KEY) == "1000000"
        assert spark.conf.get(KEY) == "1000000"
    finally:
        spark.conf.unset(KEY)
    with pytest.raises(ZeroDivisionError), _shared.small_batches(spark):
        assert spark.conf.get(KEY) == str(_shared.BATCH_BYTES)
        raise ZeroDivisionError
    assert spark.conf.get(KEY, None) is None


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(_bytes, "give_back", lambda: given.append(1))
    out = _bytes.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not given
    assert list(out) == [3] and given == [1]
