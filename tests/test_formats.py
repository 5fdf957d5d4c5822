"""Log segments, encodings, bloom filters, folds and measurement."""

import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import bloom, encoding
from tidelog.operators import blocks, measure
from tidelog.sources import wal
from tidelog.sources.storage import CrashError, FaultyStorage, NotFoundError, Storage


def test_frames():
    assert [f[3] for f in wal.frames(wal.frame(b"hello") + wal.frame(b""))] == [b"hello", b""]
    assert len(wal.frame(b"hello")) == 13 and len(wal.frame(b"")) == 8
    assert wal.frame(b"hello").hex().upper() == "0500000086A6103668656C6C6F"
    assert [f[4] for f in wal.frames(b"abc")] == [wal.TRUNCATED] and [f[4] for f in wal.frames(wal.frame(b"hello")[:-1])] == [wal.TRUNCATED]
    damaged = bytearray(wal.frame(b"hello"))
    damaged[-1] ^= 1
    assert [f[4] for f in wal.frames(wal.frame(b"x") + bytes(damaged) + wal.frame(b"y"))] == [wal.CLEAN, wal.BAD_CRC]


@settings(max_examples=200, database=None, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 2**63 - 1), st.none() | st.binary(max_size=20))
def test_records(key, seq, value):
    raw = wal.encode_record(key, seq, value)
    assert wal.decode_record(raw) == (key, seq, int(value is not None), value)
    for bad in (raw[:-1], raw + b"x", raw[:8] + b"\x07" + raw[9:]):
        with pytest.raises(wal.CorruptLogError):
            wal.decode_record(bad)


@settings(max_examples=60, database=None, deadline=None)
@given(st.lists(st.binary(max_size=39), max_size=20), st.integers(0, 400), st.integers(0, 255))
def test_any_damage_leaves_a_prefix(payloads, at, flip):
    data = bytearray(b"".join(map(wal.frame, payloads)))
    if at < len(data):
        data[at] ^= flip
    good = [f[3] for f in wal.frames(bytes(data)) if f[4] == wal.CLEAN]
    assert good == payloads[: len(good)]


def test_replay_from_files(spark, tmp_path):
    rows = [(f"k{i:03d}".encode(), i + 1, None if i % 5 == 0 else f"v{i}".encode()) for i in range(40)]
    parts = [b"".join(wal.frame(wal.encode_record(*r)) for r in rows[a : a + 10]) for a in range(0, 40, 10)]
    parts[2] = parts[2][:-3]  # the tail of a segment in the middle is torn
    for i, data in enumerate(parts, 1):
        (tmp_path / f"{i:020d}.wal").write_bytes(data)
    (tmp_path / "7.wal").write_bytes(b"junk")
    (tmp_path / f"{9:020d}.tmp").write_bytes(b"junk")
    got = sorted((r.seq, bytes(r.key), r.tag, r.value and bytes(r.value)) for r in wal.replay(spark, str(tmp_path)).collect())
    assert got == [(s, k, int(v is not None), v) for k, s, v in rows[:29]]
    report = wal.recovery_report(wal.read_segments(spark, str(tmp_path))).first()
    assert tuple(report) == (29, 3, len(b"".join(wal.frame(wal.encode_record(*r)) for r in rows[20:29])), wal.TRUNCATED)


def test_clean_and_empty_logs(spark):
    segments = spark.createDataFrame([(1, wal.frame(b"one") + wal.frame(b"two")), (2, wal.frame(b"three")), (3, b"")], "segment_id long, content binary")
    assert tuple(wal.recovery_report(segments).first()) == (3, 2, 13, wal.CLEAN)
    assert tuple(wal.recovery_report(segments.where("false")).first()) == (0, None, 0, wal.CLEAN)


def test_encodings_match_python(spark):
    rows = [(i, i * 37 % 1000, 0 if i % 3 == 0 else 1, None if i % 3 == 0 else os.urandom(i % 7)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "seq long, k long, tag int, value binary")
    framed = encoding.frame(encoding.record(F.col("seq"), F.col("tag"), encoding.big_endian_key(F.col("k")), F.col("value")))
    size = encoding.wal_length(F.lit(8), F.col("tag"), F.octet_length("value"))
    got = {r.seq: (bytes(r.f), r.n) for r in df.select("seq", framed.alias("f"), size.alias("n")).collect()}
    for seq, k, _, value in rows:
        want = wal.frame(wal.encode_record(struct.pack(">Q", k), seq, value))
        assert got[seq] == (want, len(want))


def test_generators(spark):
    got = spark.range(0, 2000, 137).select("id", encoding.bench_key(F.col("id")).alias("k"), encoding.bench_value(F.col("id")).alias("v")).collect()
    for r in got:
        seed = r.id * 0x9E3779B97F4A7C15
        assert bytes(r.k) == b"\0" * 8 + struct.pack(">Q", r.id)
        assert bytes(r.v) == struct.pack("<Q", r.id) + bytes((seed + j) & 0xFF for j in range(92))


def test_file_names(spark):
    df = spark.createDataFrame([("00000000000000000042.sst",), ("42.sst",), ("x00000000000000000042.sst",), (None,)], "n string")
    assert [r[0] for r in df.select(encoding.file_number(F.col("n"))).collect()] == [42, None, None, None]


def test_bloom(spark):
    assert bloom.size(1000) == (10000, 7) and bloom.size(0) == (64, 30)
    bits, k = bloom.size(1000)
    members = spark.range(1000).withColumnRenamed("id", "key")
    built = bloom.build(members, "key", bits, k)
    assert bloom.may_contain(members, "key", built, bits, k).where("not maybe").count() == 0
    strangers = spark.range(5000, 15000).withColumnRenamed("id", "key")
    assert bloom.may_contain(strangers, "key", built, bits, k).agg(F.avg(F.col("maybe").cast("int"))).first()[0] < 2 * bloom.theory(1000, bits, k) + 0.005


def test_folds():
    assert blocks.fold([4000, 97, 5000, 10], 4096, False) == [0, 1, 2, 3] and blocks.fold([4000, 96, 1], 4096, False) == [0, 0, 1]
    assert blocks.fold([41, 291, 41], 64, True) == [0, 0, 1] and blocks.fold([], 64, True) == []


def test_quantiles_and_summary(spark):
    df = spark.range(1, 101).select(F.col("id").alias("x"), F.lit(1).alias("g"))
    assert tuple(measure.quantiles(df, "x", (0.5, 0.99, 1.0, 7.0)).first())[:3] == (50, 99, 100)
    assert tuple(measure.summary(df, "x").first()) == (1, 100, 50)
    assert tuple(measure.summary(df.where("false"), "x").first()) == (0, 0, 0)
    assert [r.per_s for r in measure.throughput(df.withColumn("s", F.lit(0.0)), "s", "g").collect()] == [0.0]
    assert measure.order_violations(df, "x").first()[0] == 0


def test_work_partition(spark):
    got = {r.worker: r["count"] for r in measure.work_partition(spark.range(10), "id", 4).groupBy("worker").count().collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 4}
    assert sum(measure.work_partition(spark.range(2), "id", 4).groupBy("worker").count().toPandas()["count"]) == 2


def test_permutation(spark):
    a = [r.id for r in measure.shuffled(spark.range(50), "id", 1).collect()]
    assert sorted(a) == list(range(50)) and a == [r.id for r in measure.shuffled(spark.range(50), "id", 1).collect()] and a != [r.id for r in measure.shuffled(spark.range(50), "id", 2).collect()]


def test_log_writer(spark, tmp_path):
    disk = FaultyStorage(spark, str(tmp_path))
    payloads = [wal.encode_record(b"k%d" % i, i, b"v" * (i % 5)) for i in range(1, 60)]
    stored = lambda: [bytes(r.payload) for r in wal.valid_prefix(wal.read_segments(spark, str(tmp_path / "log"))).orderBy("segment_id", "frame_no").collect()]
    writer = wal.LogWriter(disk, segment_bytes=200)
    for p in payloads[:50]:
        writer.append(p)
    assert stored() == payloads[: len(stored())] and writer.active_segment == len(writer.segments()) > 5  # the rest waits for a sync
    writer.sync()
    assert stored() == payloads[:50]
    sizes = {n: disk.size(f"log/{n:020d}.wal") for n in writer.segments()}
    assert all(200 <= v < 200 + 40 for n, v in sizes.items() if n != writer.active_segment)
    again = wal.LogWriter(disk, segment_bytes=200)
    assert again.recovered == 50 and again.active_segment == writer.active_segment
    again.append(payloads[50])
    again.sync()
    assert stored() == payloads[:51]
    for number, keep, flip in ((4, 70, False), (2, 100, True), (1, 3, False)):  # torn, flipped, and without a whole frame
        disk.tear(f"log/{number:020d}.wal", keep, flip)
        left = stored()
        again = wal.LogWriter(disk, segment_bytes=200)
        assert stored() == left == payloads[: again.recovered] and again.segments()[-1] == number
        for p in payloads[again.recovered :]:
            again.append(p)
        again.sync()
        assert stored() == payloads
    again.reset()
    assert stored() == [] and again.segments() == [again.active_segment]
    assert wal.LogWriter(disk).active_segment == again.active_segment


def test_crash_while_the_tail_is_cut(spark, tmp_path):
    """Whatever operation of the recovery fails, the next one finds the same prefix."""
    payloads = [wal.encode_record(b"k", i, b"v") for i in range(1, 40)]
    writer = wal.LogWriter(Storage(spark, str(tmp_path)), segment_bytes=200)
    for p in payloads:
        writer.append(p)
    writer.sync()
    FaultyStorage(spark, str(tmp_path)).tear(f"log/{3:020d}.wal", 90, True)
    for n in range(2, 9):
        disk = FaultyStorage(spark, str(tmp_path))
        disk.arm(n)
        try:
            writer, failed = wal.LogWriter(disk, segment_bytes=200), False
        except CrashError:
            failed = True
        got = [bytes(r.payload) for r in wal.valid_prefix(wal.read_segments(spark, str(tmp_path / "log"))).orderBy("segment_id", "frame_no").collect()]
        assert got == payloads[: len(got)] and 10 < len(got) < 20
        if not failed:
            break
    assert not failed and writer.recovered == len(got) and writer.segments() == [1, 2, 3]


def test_storage(spark, tmp_path):
    disk = Storage(spark, str(tmp_path))
    assert disk.list("a") == [] and disk.publish("a/x", b"one") and not disk.publish("a/x", b"two") and disk.read("a/x") == b"one"
    disk.replace("a/x", b"\x00\xff")
    disk.replace("a/y", b"")
    assert disk.read("a/x") == b"\x00\xff" and disk.read("a/y") == b"" and disk.size("a") == 2 and sorted(n for n, _ in disk.list("a")) == ["x", "y"]
    disk.delete("a/x")
    with pytest.raises(NotFoundError):
        disk.read("a/x")
