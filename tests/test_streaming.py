"""Continuous ingest ends in the state of the batch resolution."""

import random

import pytest

from tidelog.operators import resolve as R
from tidelog.plans.table import Durability, KvTable, Options
from tidelog.streaming import ingest

SCHEMA = "key long, seq long, tag int, value double"


@pytest.fixture
def source(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(12), s, 1, float(s)) if rng.random() < 0.7 else (rng.randrange(12), s, 0, None) for s in range(1, 201)]
    rng.shuffle(rows)  # late and out of order
    for i in range(4):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r.key: (r.seq, r.tag, r.value) for r in R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, want, tmp_path


def test_complete_mode(spark, source):
    stream, want, tmp = source
    ingest.newest(stream).writeStream.outputMode("complete").format("memory").queryName("t_newest").trigger(availableNow=True).start().awaitTermination()
    assert {r.key: (r.seq, r.tag, r.value) for r in spark.table("t_newest").collect()} == want


def test_stateful_changes(spark, source):
    stream, want, tmp = source
    ingest.newest_stateful(stream).writeStream.outputMode("append").format("memory").queryName("t_changes").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("t_changes").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.seq):
        last[r.key] = (r.seq, r.tag, r.value)
    assert last == want and len(rows) >= len(want)


@pytest.mark.parametrize("mode", list(Durability))
def test_into_table_and_restart(spark, source, mode):
    """What the stream's checkpoint counts as done is in the table for other readers, whatever the durability."""
    stream, want, tmp = source
    live = {k: v for k, (_, tag, v) in want.items() if tag}
    for _ in range(2):  # the second run finds nothing new, and its handle knows nothing of the first
        table = KvTable(spark, str(tmp / "t"), "bigint", "double", Options(durability=mode, bloom=False))
        ingest.into_table(stream, table, str(tmp / "cp"), flush_every=2, availableNow=True).awaitTermination()
        assert {r.key: r.value for r in KvTable(spark, str(tmp / "t"), "bigint", "double").scan().collect()} == live
    table.refresh()
    assert table.describe().count() >= 1
    table.append(stream.sparkSession.read.schema(SCHEMA).parquet(str(tmp / "in")))  # a replay changes nothing
    assert {r.key: r.value for r in table.scan().collect()} == live
