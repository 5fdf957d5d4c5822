"""The table against a plain dictionary, commits under faults, compaction rules."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import resolve as R
from tidelog.operators.ranges import Range, multi_range, multi_range_ordered
from tidelog.plans import table as table_module
from tidelog.plans.table import CommitConflictError, CorruptSnapshotError, Durability, KvTable, Options
from tidelog.plans.tiers import TableMeta, Version
from tidelog.sources.storage import CrashError, FaultyStorage

SMALL = Options(fanout=4, bloom=False, partitions=2)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def log(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"key binary, seq long, tag int, value binary{extra}")


# --- resolution --------------------------------------------------------------------------

MIX = [(b"a", 1, 1, b"a1"), (b"b", 1, 1, b"b1"), (b"a", 5, 1, b"a2"), (b"c", 3, 1, b"c1"), (b"b", 7, 0, None), (b"d", 4, 1, b"d1"), (b"c", 9, 0, None), (b"c", 11, 1, b"c2")]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_merge_of_sources(spark, n):
    both = R.union(*[log(spark, MIX[i::n]) for i in range(n)])
    want = {b"a": b"a2", b"c": b"c2", b"d": b"d1"}
    assert dict(pairs(R.live(both, source="source"))) == want
    raw = {bytes(r.key): (r.seq, r.tag) for r in R.resolve(both, source="source").collect()}
    assert raw[b"b"] == (7, 0) and len(raw) == 4
    assert {bytes(r.key): (r.seq, r.tag) for r in R.resolve_window(both, source="source").collect()} == raw


ops = st.lists(st.tuples(st.integers(0, 9), st.booleans(), st.binary(max_size=4)), max_size=60)


def test_random_merges(spark):
    cases = []

    @settings(max_examples=120, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(ops, st.integers(1, 5))
    def gather(case, sources):
        cases.append((case, sources))

    gather()
    rows = [(i, bytes([k]), s + 1, int(put), v if put else None, s % n) for i, (case, n) in enumerate(cases) for s, (k, put, v) in enumerate(case)]
    df = spark.createDataFrame(rows, "case_id int, key binary, seq long, tag int, value binary, source int").repartition(7)
    got = {}
    for r in R.live(df, "case_id", "key", source="source").collect():
        got.setdefault(r.case_id, {})[bytes(r.key)] = bytes(r.value)
    for i, (case, _) in enumerate(cases):
        model = {}
        for k, put, v in case:
            if put:
                model[bytes([k])] = v
            else:
                model.pop(bytes([k]), None)
        assert got.get(i, {}) == model
    for cut in (0, 5, 20):
        prefix = {}
        for r in R.live(R.as_of(df, cut), "case_id", "key", source="source").collect():
            prefix.setdefault(r.case_id, {})[bytes(r.key)] = bytes(r.value)
        for i, (case, _) in enumerate(cases):
            model = {}
            for k, put, v in case[:cut]:
                model[bytes([k])] = v
                if not put:
                    del model[bytes([k])]
            assert prefix.get(i, {}) == model


def test_value_predicates_stay_above_resolution(spark):
    rows = spark.createDataFrame([(1, 1, 1, 9.0), (1, 2, 1, 1.0), (2, 1, 1, 9.0), (2, 2, 0, None)], "key long, seq long, tag int, value double")
    assert R.live(rows).where("value > 5").count() == 0
    assert R.live(rows.where("value > 5")).count() == 2  # the wrong order


def test_equal_seq_keeps_the_existing_row(spark):
    old, new = log(spark, [(b"a", 3, 1, b"old"), (b"b", 1, 1, b"x")]), log(spark, [(b"a", 3, 1, b"new"), (b"b", 2, 0, None)])
    assert {bytes(r.key): r.value and bytes(r.value) for r in R.insert_if_newer(old, new).collect()} == {b"a": b"old", b"b": None}


def test_plan_is_a_hash_aggregate_with_key_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id % 10 key", "id seq", "1 tag", "cast(id as double) value").write.parquet(str(tmp_path / "l"))
    plan = R.live(spark.read.parquet(str(tmp_path / "l"))).where("key = 3")._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,3)]" in plan


@pytest.mark.parametrize("row", [(None, 1, 1, b"x"), (b"a", None, 1, b"x"), (b"a", -1, 1, b"x"), (b"a", 1, 0, b"x"), (b"a", 1, 1, None), (b"a", 1, 2, b"x")])
def test_invalid_rows_fail(spark, row):
    with pytest.raises(Exception, match="invalid log row"):
        R.validate(log(spark, [row])).collect()


def test_assign_seq(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 v")
    got = {r.v: r.seq for r in R.assign_seq(rows, ["v"], 5).collect()}
    assert got == {v: v + 5 for v in range(1000)}


def test_byte_keys_compare_unsigned(spark):
    keys = [b"", b"a", b"\x7f", b"\x80", b"\x80\x00", b"\xff"]
    df = log(spark, [(k, i, 1, b"") for i, k in enumerate(reversed(keys))])
    assert [k for k, _ in pairs(R.live(df).orderBy("key").select("key", "value"))] == keys
    assert df.where(Range(b"\x7f", b"\x80\x00", False, True).contains()).count() == 2


@pytest.mark.parametrize("lo_incl", [True, False])
@pytest.mark.parametrize("hi_incl", [True, False])
def test_ranges(spark, lo_incl, hi_incl):
    df = spark.range(20).withColumnRenamed("id", "key")
    for lo in (None, 5, 12):
        for hi in (None, 5, 12):
            want = [k for k in range(20) if (lo is None or k > lo or (lo_incl and k == lo)) and (hi is None or k < hi or (hi_incl and k == hi))]
            assert sorted(r.key for r in df.where(Range(lo, hi, lo_incl, hi_incl).contains()).collect()) == want


def test_multi_range(spark):
    rng = random.Random(1)
    wanted = [(i, a, a + rng.randint(-2, 40)) for i, a in enumerate(rng.choices(range(-50, 300), k=30))]
    got = sorted((r.i, r.key) for r in multi_range(spark.range(200).withColumnRenamed("id", "key"), spark.createDataFrame(wanted, "i long, lo long, hi long"), 13).collect())
    assert got == sorted((i, k) for i, lo, hi in wanted for k in range(200) if lo <= k < hi)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_multi_range_of_bytes(spark, buckets):
    rng = random.Random(2)
    some = lambda: bytes(rng.choice(b"\x00a\x7f\x80\xff") for _ in range(rng.randint(0, 3)))
    keys, wanted = sorted({some() for _ in range(80)}), [(i, some(), some()) for i in range(40)]
    rows = spark.createDataFrame([(k, 1) for k in keys], "key binary, lo_ int")
    found = multi_range_ordered(rows, spark.createDataFrame(wanted, "i int, lo binary, hi binary"), buckets=buckets)
    assert sorted((r.i, bytes(r.key)) for r in found.collect()) == sorted((i, k) for i, lo, hi in wanted for k in keys if lo <= k < hi)
    assert multi_range_ordered(rows.where("false"), spark.createDataFrame(wanted, "i int, lo binary, hi binary")).collect() == []


# --- the table ----------------------------------------------------------------------------


def test_round_trip_flush_reopen(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), options=SMALL)
    t.put(b"alpha", b"1")
    t.put(b"beta", b"2")
    t.delete(b"alpha")
    t.flush()
    t.put(b"beta", b"22")
    t.put(b"empty", b"")
    assert t.get(b"alpha") is None and t.get(b"beta") == b"22" and t.get(b"missing") is None and t.get(b"empty") == b""
    again = KvTable.open(spark, str(tmp_path / "t"), options=SMALL)
    assert pairs(again.scan()) == [(b"beta", b"22"), (b"empty", b"")]
    assert pairs(again.scan(b"z", b"a")) == [] and pairs(again.scan(b"beta", b"beta", True, True)) == [(b"beta", b"22")]
    keys = spark.createDataFrame([(b"alpha",), (b"beta",), (b"nope",)], "key binary")
    assert {bytes(r.key): r.value and bytes(r.value) for r in again.multi_get(keys).collect()} == {b"alpha": None, b"beta": b"22", b"nope": None}
    with pytest.raises(ValueError):
        t.put(b"k", None)


def test_random_workload_against_a_dictionary(spark, tmp_path):
    rng = random.Random(12)
    t = KvTable(spark, str(tmp_path / "t"), "string", "string", SMALL)
    model, seq, states = {}, 0, {}
    for _ in range(14):
        rows = []
        for _ in range(rng.randint(1, 12)):
            seq += 1
            key = rng.choice("abcde") * rng.randint(1, 2)
            if rng.random() < 0.7:
                rows.append((key, seq, 1, f"v{seq}"))
                model[key] = f"v{seq}"
            else:
                rows.append((key, seq, 0, None))
                model.pop(key, None)
        rng.shuffle(rows)
        t.append(spark.createDataFrame(rows, "key string, seq long, tag int, value string"))
        if rng.random() < 0.8:
            t.flush()
        assert [(r.key, r.value) for r in t.scan().collect()] == sorted(model.items())
        states[t.number] = dict(model)
    assert t.version.next_seq == seq + 1 and t.describe().count() == sum(len(x) for x in t.version.tiers)
    for number, state in list(states.items())[-4:]:
        pinned = KvTable(spark, str(tmp_path / "t"), "string", "string", SMALL).refresh(number)
        assert [(r.key, r.value) for r in pinned.scan().collect()] == sorted(state.items())
    gone = t.vacuum(keep_snapshots=1, older_than_s=0)
    assert gone and [(r.key, r.value) for r in KvTable(spark, str(tmp_path / "t"), "string", "string", SMALL).scan().collect()] == sorted(model.items())


def test_bulk_writes_are_numbered(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "string", SMALL)
    t.put_many(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3)], "key long, value string, at int"), order_by=["at"])
    t.delete_many(spark.createDataFrame([(2,), (9,)], "key long"))
    assert [(r.key, r.value) for r in t.scan().collect()] == [(1, "a")] and t.version.next_seq == 6


def test_bulk_mode_publishes_at_flush(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(durability=Durability.BUFFERED, bloom=False))
    t.put(1, 10)
    t.put(1, 11)
    assert t.get(1) == 11 and KvTable(spark, str(tmp_path / "t"), "bigint", "bigint").get(1) is None
    t.flush()
    assert KvTable(spark, str(tmp_path / "t"), "bigint", "bigint").get(1) == 11


def test_group_commit(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(durability=Durability.parse("group-commit"), group_batches=3, bloom=False))
    for i in range(4):
        t.put(i, i)
    assert len(t.snapshots()) == 1 and KvTable(spark, str(tmp_path / "t"), "bigint", "bigint").scan().count() == 3
    t.commit()
    assert len(t.snapshots()) == 2 and KvTable(spark, str(tmp_path / "t"), "bigint", "bigint").version.next_seq == 5
    assert Durability.parse("os") is Durability.BUFFERED and not Durability.BUFFERED.is_durable and Durability.parse("always").is_durable
    with pytest.raises(ValueError):
        Durability.parse("never")


def test_large_pending_batches_are_flushed(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(flush_bytes=1, fanout=9, bloom=False))
    for i in range(3):
        t.put(i, i)
    assert t.describe().count() == 3 and t.version.pending == () and t.pending_bytes() == 0


def test_a_deleted_key_does_not_come_back(spark, tmp_path):
    """The destination of a merge holds the live version that the delete hides."""
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(fanout=2, bloom=False))
    for batch in ([(7, 1, 1, 70)], [(8, 2, 1, 80)], [(7, 3, 0, None)], [(9, 4, 1, 90)]):
        t.append(spark.createDataFrame(batch, "key long, seq long, tag int, value long"))
        t.flush()
    assert t.get(7) is None and sorted(r.key for r in t.scan().collect()) == [8, 9]


def test_commit_conflict_and_faults(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    a, b = KvTable(spark, root, "bigint", "bigint", SMALL), KvTable(spark, root, "bigint", "bigint", SMALL)
    a.put(1, 1)
    with pytest.raises(CommitConflictError):
        b.put(2, 2)
    b.refresh().put(2, 2)
    assert sorted(r.key for r in b.scan().collect()) == [1, 2]
    before = b.number
    for step in ("_write_table", "_publish"):  # a fault before or at the publication changes nothing
        with monkeypatch.context() as m:
            m.setattr(KvTable, step, lambda *x: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                b.flush()
        again = KvTable(spark, root, "bigint", "bigint", SMALL)
        assert again.number == before and sorted(r.key for r in again.scan().collect()) == [1, 2]
    b.flush()
    assert b.describe().count() == 1
    path = tmp_path / "t" / "_snapshots" / f"{b.number:020d}.json"
    (tmp_path / "t" / "_snapshots" / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_text(path.read_text().replace('"next_seq": 3', '"next_seq": 4'))
    with pytest.raises(CorruptSnapshotError):
        KvTable(spark, root, "bigint", "bigint")


def test_table_pruning_uses_key_ranges(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(fanout=9, bloom=True))
    for i in range(3):
        t.append(spark.range(i * 100, i * 100 + 100).selectExpr("id key", "id + 1 seq", "1 tag", "id value"))
        t.flush()
    files = {f.rpartition("/data/")[2].split("/")[0] for f in t.log(Range(120, 130)).inputFiles()}
    assert files == {t.version.tiers[0][1].path.partition("/")[2]}
    assert t.get(125) == 125


def test_disjoint_tables_are_not_resolved(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(fanout=9, bloom=False))
    for lo in (0, 100, 150):
        t.append(spark.range(lo, lo + 100).selectExpr("id key", f"id + {lo} * 10 + 1 seq", "if(id % 7 = 0, 0, 1) tag", f"if(id % 7 = 0, null, id + {lo}) value"))
        t.flush()
    alone, rest = table_module._split_overlapping(t.version.newest_first())
    assert [m.first_key for m in alone] == [0] and sorted(m.first_key for m in rest) == [100, 150]
    want = {k: k + (150 if k >= 150 else 100 if k >= 100 else 0) for k in range(250) if k % 7}
    assert {r.key: r.value for r in t.scan().collect()} == want
    plan = t.scan(0, 60, ordered=False)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and t.scan(0, 60).count() == sum(k < 60 for k in want)
    keys = spark.range(0, 300, 3).withColumnRenamed("id", "key")
    assert {r.key: r.value for r in t.multi_get(keys).collect()} == {k: want.get(k) for k in range(0, 300, 3)}
    t.merge_tier(0)
    assert {r.key: r.value for r in t.multi_get(keys).collect()} == {k: want.get(k) for k in range(0, 300, 3)} and t.get(7) is None and t.get(151) == 301
    t.delete(151)
    assert t.get(151) is None and t.scan().count() == len(want) - 1


def test_versions():
    meta = lambda i: TableMeta(i, f"p{i}", 1, 0, 9)
    v = Version()
    for i in range(1, 5):
        v = v.with_flush(meta(i), i)
    assert v.candidate(4) == 0 and v.candidate(5) is None and v.is_bottom(0)
    v = v.with_compaction(0, meta(5)).with_flush(meta(6), 7)
    assert [t.id for t in v.newest_first()] == [6, 5] and v.next_table_id == 7 and not v.is_bottom(0) and v.is_bottom(1)
    assert v.with_compaction(1, None).tiers == ((meta(6),),) and Version().with_flush(None, 3).tiers == ()
    assert table_module._meets(Range(9, None), meta(1)) and not table_module._meets(Range(9, None, False), meta(1))


def test_unsigned_order_of_table_ranges(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), options=SMALL)
    t.put(b"\x80", b"x")
    t.put(b"\x00", b"y")
    t.flush()
    assert t.describe().select(F.hex("first_key"), F.hex("last_key")).first()[:] == ("00", "80")
    assert t.get(b"\x80") == b"x"


@pytest.mark.parametrize("mode", list(Durability))
def test_two_writers(spark, tmp_path, mode):
    """Numbers are given at publication: what is published later wins, and no number is given twice."""
    root = str(tmp_path / "t")
    opt = Options(durability=mode, group_batches=9, bloom=False)
    a, b = KvTable(spark, root, "bigint", "string", opt), KvTable(spark, root, "bigint", "string", opt)
    if mode is Durability.ALWAYS:
        b.put(1, "b")
        with pytest.raises(CommitConflictError):
            a.put(1, "a")
        assert KvTable(spark, root, "bigint", "string").get(1) == "b"
        a.refresh().put(1, "a")
    else:
        publish = KvTable.commit if mode is Durability.GROUP_COMMIT else KvTable.flush
        a.put(1, "a")
        a.delete(7)
        b.put(1, "b")
        publish(b)
        with pytest.raises(CommitConflictError):
            publish(a)
        assert KvTable(spark, root, "bigint", "string").get(1) == "b"
        publish(a.refresh())
    new = KvTable(spark, root, "bigint", "string")
    seqs = [r.seq for r in new.log().collect()]
    assert new.get(1) == "a" and len(seqs) == len(set(seqs)) and new.version.next_seq == (3 if mode is Durability.ALWAYS else 4)
    new.append(spark.createDataFrame([(1, 50, 1, "late")], "key long, seq long, tag int, value string"))
    new.put(1, "last")
    assert new.get(1) == "last" and new.version.next_seq == 52


def test_buffered_batches_are_flushed_when_large(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "bigint", Options(durability=Durability.BUFFERED, flush_bytes=1, fanout=9, bloom=False))
    t.put(1, 1)
    t.put(2, 2)
    assert t.describe().count() == 2 and KvTable(spark, str(tmp_path / "t"), "bigint", "bigint").get(2) == 2


def test_multi_get_keeps_clashing_columns_apart(spark, tmp_path):
    t = KvTable(spark, str(tmp_path / "t"), "bigint", "string", SMALL)
    t.put(1, "x")
    keys = spark.createDataFrame([(1, "own", 5, 6), (2, "own", 5, 6)], "key long, value string, _k int, seq int")
    assert [r.asDict() for r in t.multi_get(keys).orderBy("key").collect()] == [{"key": 1, "_k": 5, "seq": 6, "value": "x"}, {"key": 2, "_k": 5, "seq": 6, "value": None}]
    assert t.multi_get(keys, into="found").where("key = 1").first().asDict() == {"key": 1, "value": "own", "_k": 5, "seq": 6, "found": "x"}


def _workload(t):
    """Yields the state that each step acknowledges, before and after it."""
    model = {}
    for i, (key, value) in enumerate([(1, 10), (2, 20), (1, None), (3, 30)]):
        new = {k: v for k, v in {**model, key: value}.items() if v is not None}
        yield model, new
        t.delete(key) if value is None else t.put(key, value)
        model = new
        if i in (1, 3):
            yield model, model
            t.flush()  # the second one merges a tier
    yield model, model
    t.vacuum(1, 0)
    yield model, model


def _crash(spark, root, opt, n, done):
    """Run the workload until the n-th operation fails: (states it may leave, whether it failed)."""
    disk = FaultyStorage(spark, root)
    states = ({}, {})
    try:
        t = KvTable(spark, root, "bigint", "bigint", opt, storage=disk)
        disk.arm(n, done)
        for states in _workload(t):
            pass
    except CrashError:
        return states, True
    return states, False


@pytest.mark.parametrize("done", [False, True])
def test_crash_sweep(spark, tmp_path, done):
    """A fault before or after any storage operation leaves the acknowledged state or that of the step under way."""
    opt = Options(fanout=2, bloom=False, partitions=1)
    for n in range(1, 99):
        root = str(tmp_path / f"t{n}")
        states, failed = _crash(spark, root, opt, n, done)
        again = KvTable(spark, root, "bigint", "bigint", opt)
        got = {r.key: r.value for r in again.scan(ordered=False).collect()}
        assert got in states, (n, got, states)
        if not failed:
            break
        if n % 5 == 1:  # and it can be written on
            again.put(9, 90)
            again.flush()
            assert KvTable(spark, root, "bigint", "bigint", opt).get(9) == 90
    assert n > 12 and got == {2: 20, 3: 30}
