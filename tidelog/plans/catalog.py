"""Registered queries of the versioned key/value engine, with their SQL.

Every query reads one of two logs that the driver's tables make up: EV (events
by user, ``error`` events are deletes) and ORD (orders by customer, status
``P`` is a delete).  ORDK is the orders by their own key, which rises with the
sequence number, so that its tables have disjoint key ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, encoding
from tidelog.functions.session import shared_dir
from tidelog.operators import blocks, measure, ranges
from tidelog.operators import resolve as R
from tidelog.operators.ranges import Range
from tidelog.plans import tiers
from tidelog.plans.table import Durability, KvTable, Options
from tidelog.sources import wal
from tidelog.sources.storage import Storage
from tidelog.streaming import ingest

#: Versions of one flushed table, tables of a full tier.
FLUSH, FANOUT = 1000, 4

_registry: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _registry[name or f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _registry.items() if s}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidelog-{what}-{uuid.uuid4().hex}"


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    put = F.col("event_type") != "error"
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("int").alias("tag"), F.when(put, F.col("value")).alias("value"))


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    put = F.col("o_orderstatus") != "P"
    return o.select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), put.cast("int").alias("tag"), F.when(put, F.col("o_totalprice")).alias("value"))


def flushed(log: DataFrame) -> DataFrame:
    return log.withColumn("flush_no", F.expr(f"(seq - 1) div {FLUSH} + 1"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV's tables with the tier that cascading merges have brought each flush to."""
    log = flushed(ev(spark, sf_dir))
    meta = tiers.table_meta(R.resolve(log, "flush_no", "key"), "flush_no")
    total = meta.agg(F.max("flush_no").alias("total"))
    return tiers.tier_layout(meta.join(F.broadcast(total)), "total")


def merged_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META rows after the merges: flushes of one group have become one table."""
    rows = layout(spark, sf_dir)
    group = F.expr(f"ceil(flush_no / power({FANOUT}, tier))").cast("bigint")
    merged = rows.groupBy("tier", group.alias("grp")).agg(F.max("flush_no").alias("id"), F.sum("num_entries").alias("num_entries"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    pos = F.row_number().over(Window.partitionBy("tier").orderBy("id")) - 1
    return merged.withColumn("pos", pos.cast("int")).drop("grp")


EV = "WITH log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS tag, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
ORD = "WITH log AS (SELECT o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS tag, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders)"
NEW = ", newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
FLUSHED = EV + f", fl AS (SELECT *, (seq - 1) // {FLUSH} + 1 AS flush_no FROM log), per AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY flush_no, key ORDER BY seq DESC) = 1)"
META = FLUSHED + ", meta AS (SELECT flush_no, count(*) AS num_entries, min(key) AS first_key, max(key) AS last_key FROM per GROUP BY flush_no)"
LAYOUT = META + ", lay AS (SELECT *, CASE " + " ".join(f"WHEN ceil(flush_no / {4**t}.0) * {4**t} <= (SELECT max(flush_no) FROM meta) THEN {t}" for t in range(15, 0, -1)) + " ELSE 0 END AS tier FROM meta)"
MERGED = LAYOUT + (
    ", merged AS (SELECT tier, max(flush_no) AS id, sum(num_entries)::BIGINT AS num_entries, min(first_key) AS first_key, max(last_key) AS last_key FROM lay GROUP BY tier, ceil(flush_no / pow(4, tier)))"
    ", m AS (SELECT *, (row_number() OVER (PARTITION BY tier ORDER BY id) - 1)::INT AS pos FROM merged)"
)


# --- resolution ---------------------------------------------------------------------


@query(EV + NEW + " SELECT key, seq, value FROM newest WHERE tag = 1")
def live_view(spark, sf_dir):
    return R.live(ev(spark, sf_dir))


@query(EV + NEW + " SELECT key, value FROM newest WHERE tag = 1")
def scan_full(spark, sf_dir):
    return R.live(ev(spark, sf_dir)).select("key", "value").orderBy("key")


@query(ORD + NEW + " SELECT key, seq, value FROM newest WHERE tag = 1")
def live_orders(spark, sf_dir):
    return R.live(ord_(spark, sf_dir))


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def merge_raw(spark, sf_dir):
    log = ev(spark, sf_dir)
    return R.resolve(R.union(*[log.where(F.col("seq") % 4 == i) for i in range(4)]), source="source").drop("source")


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def merge_raw_window(spark, sf_dir):
    log = ev(spark, sf_dir)
    return R.resolve_window(R.union(*[log.where(F.col("seq") % 3 == i) for i in range(3)]), source="source").drop("source")


@query(EV + NEW + " SELECT key, seq, value FROM newest WHERE tag = 1")
def merge_live(spark, sf_dir):
    log = ev(spark, sf_dir)
    half = R.resolve(log.where("seq % 2 = 0")).unionByName(R.resolve(log.where("seq % 2 = 1")))
    return R.live(half)


@query(EV + NEW + " SELECT key, seq FROM newest WHERE tag = 0")
def tombstones_only(spark, sf_dir):
    return R.tombstones(ev(spark, sf_dir)).select("key", "seq")


@query(EV + ", l2 AS (SELECT * FROM log WHERE seq <= 5000) SELECT key, seq, value FROM (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE tag = 1")
def as_of_seq(spark, sf_dir):
    return R.live(R.as_of(ev(spark, sf_dir), 5000))


@query(
    EV + ", a AS (SELECT *, 0 AS source FROM log WHERE seq <= 6000), b AS (SELECT key, seq, tag, value + 1 AS value, 1 AS source FROM log WHERE seq > 4000)"
    " SELECT key, seq, tag, value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, source) = 1"
)
def insert_if_newer(spark, sf_dir):
    log = ev(spark, sf_dir)
    return R.insert_if_newer(log.where("seq <= 6000"), log.where("seq > 4000").withColumn("value", F.col("value") + 1))


@query(EV + " SELECT (seq % 3)::INT AS source, count(*) AS n, sum(tag)::BIGINT AS puts, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1")
def union_sources(spark, sf_dir):
    log = ev(spark, sf_dir)
    both = R.union(*[log.where(F.col("seq") % 3 == i) for i in range(3)])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("tag").alias("puts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(EV + " SELECT key, seq, tag, value FROM log")
def log_ingest(spark, sf_dir):
    return R.validate(ev(spark, sf_dir))


@query(
    FLUSHED + ", n AS (SELECT DISTINCT flush_no AS n FROM fl), p AS (SELECT n, fl.* FROM n JOIN fl ON flush_no <= n)"
    " SELECT n AS flush_no, count(*) FILTER (tag = 1) AS live_keys FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY n, key ORDER BY seq DESC) = 1) GROUP BY n"
)
def crash_prefix_states(spark, sf_dir):
    """The live keys that recovery finds after a crash behind each flush: the state of every prefix."""
    return R.prefix_counts(flushed(ev(spark, sf_dir)), "flush_no").select("flush_no", "live_keys")


_BYTES = (
    "WITH log AS (SELECT upper(substr(sha1(coalesce(text, '')), 1, 2 * (turn % 4)::INT)) AS key, conv_id * 1000 + turn + 1 AS seq, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END AS tag,"
    " CASE WHEN turn % 7 = 3 THEN '' ELSE coalesce(text, '') END AS value FROM conversations)"
)


def _byte_log(spark, sf_dir):
    """Turns under keys of zero to three bytes, with prefixes of each other and bytes from 0x80; some values are empty."""
    c = _read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    key = F.expr("substring(unhex(sha1(text)), 1, cast(turn % 4 as int))")
    value = F.encode(F.when(F.col("turn") % 7 == 3, "").otherwise(F.col("text")), "utf-8")
    put = F.col("turn") % 5 != 4
    return c.select(key.alias("key"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("seq"), put.cast("int").alias("tag"), F.when(put, value).alias("value"))


@query(
    _BYTES + NEW + " SELECT key AS key_hex, sha256(value) AS value_sha256, row_number() OVER (ORDER BY key) AS place FROM newest WHERE tag = 1 AND key > '01' AND key <= 'C0'"
)
def byte_key_scan(spark, sf_dir):
    """A table of byte keys: a range in unsigned order, numbered in that order."""
    table = KvTable(spark, _scratch(spark, "bytes"), options=Options(bloom=False))
    log = _byte_log(spark, sf_dir)
    table.append(log.where("seq % 3 > 0"))
    table.flush()
    table.append(log.where("seq % 3 = 0"))
    rows = R.assign_seq(table.scan(b"\x01", b"\xc0", False, True, ordered=False), ["key"], 1)
    return rows.select(F.hex("key").alias("key_hex"), F.sha2("value", 256).alias("value_sha256"), F.col("seq").alias("place"))


@query(_BYTES + NEW + ", f AS (SELECT DISTINCT substr(key, 1, 2) AS p FROM log) SELECT p AS key_hex, CASE WHEN tag = 1 THEN octet_length(encode(value)) END::BIGINT AS bytes FROM f LEFT JOIN newest ON key = p")
def byte_key_get(spark, sf_dir):
    """Keys that are prefixes of others, present, deleted and absent."""
    table = KvTable(spark, _scratch(spark, "bytes"), options=Options(bloom=False))
    log = _byte_log(spark, sf_dir)
    table.append(log)
    asked = log.select(F.expr("substring(key, 1, 1)").alias("key")).distinct()
    return table.multi_get(asked).select(F.hex("key").alias("key_hex"), F.octet_length("value").cast("bigint").alias("bytes"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS seq FROM orders")
def assign_seq(spark, sf_dir):
    return R.assign_seq(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "seq")


@query("SELECT o_custkey AS key, o_orderkey, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_writer_wins(spark, sf_dir):
    """Unconditional upserts: the last row in order of arrival wins."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("arrival"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return R.resolve(rows, seq="arrival").drop("arrival")


# --- lookups ------------------------------------------------------------------------


@query(ORD + NEW + ", k AS (SELECT min(key) AS k FROM newest WHERE tag = 1) SELECT key, value FROM newest, k WHERE tag = 1 AND key = k")
def point_get_hit(spark, sf_dir):
    log = ord_(spark, sf_dir)
    key = R.live(log).agg(F.min("key")).first()[0]
    return R.live(ranges.scan(log, Range(key, key, True, True))).select("key", "value")


@query(ORD + NEW + ", k AS (SELECT min(key) AS k FROM newest WHERE tag = 0) SELECT key, value FROM newest, k WHERE tag = 1 AND key = k")
def point_get_deleted(spark, sf_dir):
    log = ord_(spark, sf_dir)
    key = R.tombstones(log).agg(F.min("key")).first()[0]
    return R.live(ranges.scan(log, Range(key, key, True, True))).select("key", "value")


@query(ORD + NEW + " SELECT key, value FROM newest WHERE tag = 1 AND key = -5")
def point_get_absent(spark, sf_dir):
    return R.live(ranges.scan(ord_(spark, sf_dir), Range(-5, -5, True, True))).select("key", "value")


@query(ORD + NEW + " SELECT key, seq, tag, value FROM newest WHERE key IN (1, 2, 3, 4, 5)")
def get_raw_version(spark, sf_dir):
    return R.resolve(ord_(spark, sf_dir).where("key in (1, 2, 3, 4, 5)"))


@query(ORD + NEW + " SELECT c_custkey, value FROM customer LEFT JOIN (SELECT * FROM newest WHERE tag = 1) ON key = c_custkey")
def multi_get(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select("c_custkey")
    log = ord_(spark, sf_dir)
    found = R.live(log.join(keys.select(F.col("c_custkey").alias("key")), "key", "left_semi"))
    return keys.join(found, F.col("c_custkey") == F.col("key"), "left").select("c_custkey", "value")


@query("SELECT c.c_custkey, max(f.first_key) AS block_first FROM customer c LEFT JOIN (SELECT min(o_custkey) AS first_key FROM orders GROUP BY o_custkey // 100) f ON f.first_key <= c.c_custkey GROUP BY 1")
def sparse_index_lookup(spark, sf_dir):
    firsts = _read(spark, sf_dir, "orders").groupBy(F.expr("o_custkey div 100")).agg(F.min("o_custkey").alias("first_key")).select("first_key")
    return ranges.last_at_most(_read(spark, sf_dir, "customer").select("c_custkey"), firsts, "c_custkey", "first_key", "block_first")


# --- ranges -------------------------------------------------------------------------

_RANGES = {
    "incl_excl": (Range(20, 60), "key >= 20 AND key < 60"),
    "incl_incl": (Range(20, 60, True, True), "key >= 20 AND key <= 60"),
    "excl_incl": (Range(20, 60, False, True), "key > 20 AND key <= 60"),
    "excl_excl": (Range(20, 60, False, False), "key > 20 AND key < 60"),
    "from": (Range(lo=20), "key >= 20"),
    "from_excl": (Range(lo=20, lo_incl=False), "key > 20"),
    "to": (Range(hi=60), "key < 60"),
    "to_incl": (Range(hi=60, hi_incl=True), "key <= 60"),
    "unbounded": (Range(), "true"),
    "crossed": (Range(60, 20), "false"),
}
for _name, (_range, _sql) in _RANGES.items():

    @query(EV + NEW + f" SELECT key, seq, value FROM newest WHERE tag = 1 AND {_sql}", f"scan_range_{_name}")
    def _scan(spark, sf_dir, r=_range):
        return R.live(ranges.scan(ev(spark, sf_dir), r)).orderBy("key")


@query(EV + NEW + " SELECT count(*) AS pairs FROM newest WHERE tag = 1 AND key >= 20 AND key < 60")
def scan_count(spark, sf_dir):
    return R.live(ranges.scan(ev(spark, sf_dir), Range(20, 60))).agg(F.count("*").alias("pairs"))


@query(ORD + NEW + " SELECT key, value FROM newest WHERE tag = 1 ORDER BY key LIMIT 25")
def scan_take_n(spark, sf_dir):
    return R.live(ord_(spark, sf_dir)).select("key", "value").orderBy("key").limit(25)


@query(EV + NEW + " SELECT count(*) AS violations FROM (SELECT key, lag(key) OVER (ORDER BY key) AS before FROM newest WHERE tag = 1) WHERE before >= key")
def scan_strictly_ascending(spark, sf_dir):
    return measure.order_violations(R.live(ev(spark, sf_dir)), "key")


@query(
    ORD + NEW + ", r AS (SELECT c_custkey AS range_id, c_custkey AS lo, c_custkey + 15 AS hi FROM customer)"
    " SELECT range_id, count(key) AS pairs, coalesce(min(key), -1) AS first_key FROM r LEFT JOIN (SELECT * FROM newest WHERE tag = 1) ON key >= lo AND key < hi GROUP BY range_id HAVING count(key) > 0"
)
def multi_range_scan(spark, sf_dir):
    windows = _read(spark, sf_dir, "customer").selectExpr("c_custkey range_id", "c_custkey lo", "c_custkey + 15 hi")
    found = ranges.multi_range(R.live(ord_(spark, sf_dir)), windows, 15)
    return found.groupBy("range_id").agg(F.count("*").alias("pairs"), F.min("key").alias("first_key"))


# --- accounting ----------------------------------------------------------------------


@query(FLUSHED + " SELECT flush_no, sum(8 + CASE WHEN tag = 1 THEN 8 ELSE 0 END + 32)::BIGINT AS bytes, count(*) AS keys FROM per GROUP BY flush_no")
def memtable_bytes(spark, sf_dir):
    rows = R.resolve(flushed(ev(spark, sf_dir)), "flush_no", "key")
    return rows.groupBy("flush_no").agg(F.sum(encoding.memtable_length(F.lit(8), F.col("tag"), F.lit(8))).alias("bytes"), F.count("*").alias("keys"))


@query(EV + " SELECT count(DISTINCT key) AS keys FROM log")
def key_count(spark, sf_dir):
    return ev(spark, sf_dir).agg(F.countDistinct("key").alias("keys"))


@query(EV + " SELECT greatest(1, max(seq) + 1) AS next_seq FROM log")
def next_seq(spark, sf_dir):
    return ev(spark, sf_dir).agg(F.greatest(F.lit(1), F.max("seq") + 1).alias("next_seq"))


_TEXT = "SELECT conv_id, turn, 16 AS k, CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END AS tag, octet_length(encode(text)) AS v FROM conversations"


def _conv(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, 0).otherwise(1).alias("tag"), F.octet_length("text").alias("v"))


@query(f"SELECT conv_id, sum(4 + k + 9 + CASE WHEN tag = 1 THEN 4 + v ELSE 0 END)::BIGINT AS bytes FROM ({_TEXT}) GROUP BY conv_id")
def entry_len(spark, sf_dir):
    return _conv(spark, sf_dir).groupBy("conv_id").agg(F.sum(encoding.entry_length(F.lit(16), F.col("tag"), F.col("v"))).alias("bytes"))


@query(f"SELECT conv_id, sum(8 + 13 + k + CASE WHEN tag = 1 THEN 4 + v ELSE 0 END)::BIGINT AS bytes FROM ({_TEXT}) GROUP BY conv_id")
def wal_bytes(spark, sf_dir):
    return _conv(spark, sf_dir).groupBy("conv_id").agg(F.sum(encoding.wal_length(F.lit(16), F.col("tag"), F.col("v"))).alias("bytes"))


# --- tables and tiers -----------------------------------------------------------------


@query(META + " SELECT * FROM meta")
def table_meta(spark, sf_dir):
    return tiers.table_meta(R.resolve(flushed(ev(spark, sf_dir)), "flush_no", "key"), "flush_no")


@query(LAYOUT + " SELECT flush_no, tier FROM lay")
def tier_layout(spark, sf_dir):
    return layout(spark, sf_dir).select("flush_no", "tier")


@query(MERGED + " SELECT tier, count(*) AS tables FROM m GROUP BY tier")
def tier_sizes(spark, sf_dir):
    return tiers.tier_sizes(merged_layout(spark, sf_dir))


@query(MERGED + " SELECT id, tier, pos, row_number() OVER (ORDER BY tier, pos DESC)::INT AS age_rank FROM m")
def tables_newest_first(spark, sf_dir):
    return tiers.newest_first(merged_layout(spark, sf_dir)).select("id", "tier", "pos", "age_rank")


@query(MERGED + " SELECT DISTINCT id FROM m")
def referenced_ids(spark, sf_dir):
    return merged_layout(spark, sf_dir).select("id").distinct()


@query(MERGED + " SELECT tier, sum(num_entries)::BIGINT AS expected_keys FROM m GROUP BY tier")
def merge_expected_keys(spark, sf_dir):
    """An upper bound of the keys of each tier's merge."""
    return merged_layout(spark, sf_dir).groupBy("tier").agg(F.sum("num_entries").alias("expected_keys"))


@query(META + " SELECT CASE WHEN count(*) >= 4 THEN 0 END AS tier FROM meta")
def compaction_candidate(spark, sf_dir):
    meta = table_meta(spark, sf_dir).withColumn("tier", F.lit(0))
    return tiers.candidate(meta, FANOUT)


@query(MERGED + " SELECT DISTINCT tier, tier >= (SELECT max(tier) FROM m) AS is_bottom FROM m")
def output_is_bottom(spark, sf_dir):
    return tiers.output_is_bottom(merged_layout(spark, sf_dir))


_GROUPS = f", g AS (SELECT *, ceil(flush_no / {FANOUT}.0)::BIGINT AS grp FROM per)"


@query(FLUSHED + _GROUPS + " SELECT grp, key, seq, tag, value FROM g QUALIFY row_number() OVER (PARTITION BY grp, key ORDER BY seq DESC) = 1")
def compact_keep_tombstones(spark, sf_dir):
    """Every group of four flushes merged into a table that is not the oldest."""
    tables = R.resolve(flushed(ev(spark, sf_dir)), "flush_no", "key").withColumn("grp", F.ceil(F.col("flush_no") / FANOUT)).drop("flush_no")
    return R.resolve(tables, "grp", "key")


@query(FLUSHED + " SELECT key, seq, tag, value FROM (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE tag = 1")
def compact_drop_tombstones(spark, sf_dir):
    """All flushes merged into the only table."""
    tables = R.resolve(flushed(ev(spark, sf_dir)), "flush_no", "key").drop("flush_no")
    return R.resolve(tables).where(R.is_put())


@query(
    EV + ", t AS (SELECT *, (seq - 1) * 10 // (SELECT max(seq) FROM log) AS part FROM log)"
    " SELECT key, seq, tag, value FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE tag = 1 OR part >= 4"
)
def merge_cascade(spark, sf_dir):
    """Ten flushes of a table with a fanout of four: what all its files hold together.

    The first four become the only table and lose their deletes; the next four
    are merged above it and keep theirs, as they hide older versions.
    """
    log = ev(spark, sf_dir)
    most = log.agg(F.max("seq")).first()[0] or 1
    table = KvTable(spark, _scratch(spark, "cascade"), "bigint", "double", Options(bloom=False, fanout=FANOUT))
    for part in range(10):
        table.append(log.where(f"(seq - 1) * 10 div {most} = {part}"))
        table.flush()
    return table.resolved().select("key", "seq", F.col("tag").cast("int").alias("tag"), "value")


_ORDK = f"SELECT o_orderkey // {FLUSH} + 1 AS id, count(*) AS num_entries, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1"


@query(f"SELECT * FROM ({_ORDK}) WHERE last_key >= 500 AND first_key < 2500")
def table_prune(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {FLUSH} + 1").alias("id"), F.col("o_orderkey").alias("key"))
    return tiers.prune(tiers.table_meta(o), Range(500, 2500))


@query(MERGED + " SELECT flush_no AS id FROM meta WHERE flush_no NOT IN (SELECT id FROM m)")
def gc_orphans(spark, sf_dir):
    files = table_meta(spark, sf_dir).select(F.col("flush_no").alias("id"))
    return tiers.orphans(files, merged_layout(spark, sf_dir))


@query(META + " SELECT flush_no AS id, lpad(flush_no::VARCHAR, 20, '0') || '.sst' AS file_name, flush_no AS parsed FROM meta")
def file_names(spark, sf_dir):
    named = table_meta(spark, sf_dir).select(F.col("flush_no").alias("id"), encoding.file_name(F.col("flush_no")).alias("file_name"))
    return named.withColumn("parsed", encoding.file_number(F.col("file_name")))


@query(FLUSHED + " SELECT key, seq, value FROM (SELECT * FROM per WHERE flush_no <= 6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE tag = 1")
def snapshot_read(spark, sf_dir):
    """Reads a pinned snapshot of a table that has been written to since."""
    root = _scratch(spark, "snapshot")
    table = KvTable(spark, root, "bigint", "double", Options(bloom=False, fanout=FANOUT))
    log = ev(spark, sf_dir)
    table.append(log.where(f"seq <= {6 * FLUSH}"))
    table.flush()
    pinned = KvTable(spark, root, "bigint", "double")
    table.append(log.where(f"seq > {6 * FLUSH}"))
    table.flush()
    return R.live(pinned.log()).select("key", "seq", "value")


# --- blocks, bloom filters -------------------------------------------------------------


@query(
    f"WITH RECURSIVE e AS (SELECT o_orderkey // {FLUSH} AS t, o_orderkey AS k, 29 + o_orderkey % 97 AS len, row_number() OVER (PARTITION BY o_orderkey // {FLUSH} ORDER BY o_orderkey) AS i FROM orders),"
    " f AS (SELECT t, i, k, len, len AS used, 0 AS block FROM e WHERE i = 1 UNION ALL"
    " SELECT e.t, e.i, e.k, e.len, CASE WHEN f.used + e.len > 4096 THEN e.len ELSE f.used + e.len END, CASE WHEN f.used + e.len > 4096 THEN f.block + 1 ELSE f.block END FROM f JOIN e ON e.t = f.t AND e.i = f.i + 1)"
    " SELECT t AS table_id, block::BIGINT AS block, count(*) AS entries, min(k) AS first_key, sum(len)::BIGINT AS bytes FROM f GROUP BY t, block"
)
def block_layout(spark, sf_dir):
    """Greedy packing of every table's entries into blocks of 4 KiB."""
    rows = _read(spark, sf_dir, "orders").selectExpr(f"o_orderkey div {FLUSH} table_id", "o_orderkey key", "29 + o_orderkey % 97 len")
    return blocks.pack(rows, "table_id", "key", "len").select("table_id", "block", "entries", "first_key", "bytes")


@query(
    f"WITH RECURSIVE e AS (SELECT o_orderkey // {FLUSH} AS t, o_orderkey AS k, 40 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 8 END AS len, row_number() OVER (PARTITION BY o_orderkey // {FLUSH} ORDER BY o_orderkey) AS i FROM orders),"
    " f AS (SELECT t, i, k, len, len AS used, 0 AS batch FROM e WHERE i = 1 UNION ALL"
    " SELECT e.t, e.i, e.k, e.len, CASE WHEN f.used >= 4096 THEN e.len ELSE f.used + e.len END, CASE WHEN f.used >= 4096 THEN f.batch + 1 ELSE f.batch END FROM f JOIN e ON e.t = f.t AND e.i = f.i + 1)"
    " SELECT t AS table_id, batch::BIGINT AS batch, count(*) AS entries, max(k) AS last_key, sum(len)::BIGINT AS bytes FROM f GROUP BY t, batch"
)
def freeze_points(spark, sf_dir):
    """Where a memtable of 4 KiB would be frozen while each table's entries come in."""
    size = encoding.memtable_length(F.lit(8), (F.col("o_orderstatus") != "P").cast("int"), F.lit(8))
    rows = _read(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {FLUSH}").alias("table_id"), F.col("o_orderkey").alias("key"), size.alias("len"))
    return blocks.pack(rows, "table_id", "key", "len", after=True).select("table_id", F.col("block").alias("batch"), "entries", "last_key", "bytes")


@query(META + ", b AS (SELECT flush_no, num_entries AS n, ceil(greatest(64, num_entries * 10) / 8.0) * 8 AS bits FROM meta) SELECT flush_no, bits::BIGINT AS bits, least(30, greatest(1, floor(bits / n * ln(2) + 0.5)))::BIGINT AS probes FROM b")
def bloom_sizing(spark, sf_dir):
    bits, probes = bloom.size_columns(F.col("num_entries"))
    return table_meta(spark, sf_dir).select("flush_no", bits.alias("bits"), probes.alias("probes"))


def _bloom(spark, sf_dir):
    members = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    bits, k = bloom.size(members.count())
    return members, bits, k


@query("SELECT count(*) AS members, 0::BIGINT AS missed FROM (SELECT DISTINCT o_custkey FROM orders)")
def bloom_membership(spark, sf_dir):
    """No member may be missed."""
    members, bits, k = _bloom(spark, sf_dir)
    asked = bloom.may_contain(members, "key", bloom.build(members, "key", bits, k), bits, k)
    return asked.agg(F.count("*").alias("members"), F.sum((~F.col("maybe")).cast("bigint")).alias("missed"))


@query("SELECT 20000::BIGINT AS trials, true AS in_bound")
def bloom_fpr(spark, sf_dir):
    """The share of false positives stays below twice the theory plus half a percent."""
    members, bits, k = _bloom(spark, sf_dir)
    strangers = spark.range(20_000).select((-1 - F.col("id")).alias("key"))
    asked = bloom.may_contain(strangers, "key", bloom.build(members, "key", bits, k), bits, k)
    bound = 2 * bloom.theory(members.count(), bits, k) + 0.005
    return asked.agg(F.count("*").alias("trials"), (F.avg(F.col("maybe").cast("int")) < bound).alias("in_bound"))


# --- log segments -----------------------------------------------------------------------


#: CRC-32 of one byte, for every byte; the polynomial is a fixed value.
def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_FRAMES = (
    "WITH e AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS tag, lpad(hex(user_id), 16, '0') AS k, lpad(hex((value * 100)::BIGINT), 16, '0') AS v FROM events),"
    " p AS (SELECT *, lpad(hex(seq), 16, '0') AS s FROM e),"
    " q AS (SELECT seq, list_reduce(list_prepend('', list_transform(range(8), lambda i: substr(s, 15 - 2 * i, 2))), lambda a, b: a || b) || '0' || tag || '08000000' || k ||"
    " CASE WHEN tag = 1 THEN '08000000' || list_reduce(list_prepend('', list_transform(range(8), lambda i: substr(v, 15 - 2 * i, 2))), lambda a, b: a || b) ELSE '' END AS body FROM p),"
    f" t AS (SELECT {_crc_table()}::BIGINT[] AS t),"
    " c AS (SELECT seq, body, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(body) // 2), lambda i: ('0x' || substr(body, 1 + 2 * i, 2))::BIGINT)),"
    " lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS crc FROM q, t)"
    " SELECT seq, list_reduce(list_transform([length(body) // 2, crc], lambda x: lpad(hex(x & 255), 2, '0') || lpad(hex((x >> 8) & 255), 2, '0') || lpad(hex((x >> 16) & 255), 2, '0') || lpad(hex(x >> 24), 2, '0')),"
    " lambda a, b: a || b) || body AS frame FROM c"
)


def _payload():
    value = F.when(F.col("tag") == 1, encoding.little_endian(F.round(F.col("value") * 100).cast("bigint"), 8))
    return encoding.record(F.col("seq"), F.col("tag"), encoding.big_endian_key(F.col("key")), value)


@query(_FRAMES)
def frame_crc(spark, sf_dir):
    """Every event as a framed log record."""
    return ev(spark, sf_dir).select("seq", F.hex(encoding.frame(_payload())).alias("frame"))


#: Bytes from which a log's segment is full.
SEGMENT = 1 << 16
_ROTATED = (
    EV + ", c AS (SELECT seq, sum(29 + CASE WHEN tag = 1 THEN 12 ELSE 0 END) OVER (ORDER BY seq)::BIGINT AS total FROM log)"
)


def _written(spark, sf_dir, storage, folder, after: int = 0):
    """Append EV's records behind a sequence number to a log, in order."""
    log = wal.LogWriter(storage, folder, SEGMENT)
    for row in ev(spark, sf_dir).where(f"seq > {after}").orderBy("seq").select(_payload().alias("p")).toLocalIterator(prefetchPartitions=True):
        log.append(bytes(row.p))
    log.sync()
    return log


@query(
    _ROTATED.replace("WITH log", "WITH RECURSIVE log") + f", f AS (SELECT 1::BIGINT AS segment_id, 0::BIGINT AS done, (SELECT min(total) FROM c WHERE total >= {SEGMENT}) AS upto"
    f" UNION ALL SELECT segment_id + 1, upto, (SELECT min(total) FROM c WHERE total >= f.upto + {SEGMENT}) FROM f WHERE upto IS NOT NULL)"
    " SELECT segment_id, count(seq) AS frames, (coalesce(max(total), any_value(done)) - any_value(done))::BIGINT AS valid_len FROM f LEFT JOIN c ON total > done AND (upto IS NULL OR total <= upto) GROUP BY segment_id"
)
def wal_rotation(spark, sf_dir):
    """The segments of a log that is written record by record and rotates at a size."""
    storage = Storage(spark, _scratch(spark, "log"))
    _written(spark, sf_dir, storage, "log")
    return wal.segment_states(wal.read_segments(spark, f"{storage.root}/log")).select("segment_id", "frames", "valid_len")


@query(EV + " SELECT key, seq, tag, value FROM log")
def wal_truncate_reopen(spark, sf_dir):
    """A log torn in the middle of a segment is reopened, cut there and written on: the whole log again."""
    storage = Storage(spark, _scratch(spark, "log"))
    log = _written(spark, sf_dir, storage, "log")
    torn = f"log/{(log.active_segment + 1) // 2:020d}.wal"
    storage.replace(torn, storage.read(torn)[: SEGMENT // 3])
    log = wal.LogWriter(storage, "log", SEGMENT)
    _written(spark, sf_dir, storage, "log", log.recovered)
    return _replayed(wal.replay(spark, f"{storage.root}/log"))


def _segments(spark, sf_dir, damaged: int | None = None):
    """EV's log in segments of FLUSH frames, the last byte of one frame changed."""
    e = ev(spark, sf_dir)
    framed = encoding.frame(_payload())
    if damaged:
        framed = F.when(F.col("seq") == damaged, F.concat(F.substr(framed, F.lit(1), F.octet_length(framed) - 1), F.unhex(F.lit("FF")))).otherwise(framed)
    rows = e.select(F.expr(f"(seq - 1) div {FLUSH}").alias("segment_id"), "seq", F.hex(framed).alias("f"))
    parts = rows.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("seq", "f"))).alias("rows"))
    return parts.select("segment_id", F.unhex(F.array_join("rows.f", "")).alias("content"))


def _damaged(spark, sf_dir) -> int:
    """A frame behind three fifths of the log, whatever its size."""
    return (ev(spark, sf_dir).agg(F.max("seq")).first()[0] or 0) * 3 // 5 + 1


def _replayed(rows: DataFrame) -> DataFrame:
    return rows.select(F.conv(F.hex("key"), 16, 10).cast("bigint").alias("key"), "seq", F.col("tag").cast("int").alias("tag"), (encoding.number(F.col("value")) / 100).alias("value"))


@query(EV + " SELECT key, seq, tag, value FROM log WHERE seq <= (SELECT max(seq) * 3 // 5 FROM log)")
def wal_valid_prefix(spark, sf_dir):
    """Decode and replay a log with one damaged frame."""
    return _replayed(wal.records(wal.valid_prefix(_segments(spark, sf_dir, _damaged(spark, sf_dir)))))


@query(EV + " SELECT key, seq, tag, value FROM log")
def wal_clean_replay(spark, sf_dir):
    """Decode and replay a whole log."""
    return _replayed(wal.records(wal.valid_prefix(_segments(spark, sf_dir))))


@query(EV + ", h AS (SELECT max(seq) * 3 // 5 AS n FROM log) SELECT n::BIGINT AS records, n // 1000 AS tail_segment, 'BadCrc' AS stop_reason FROM h")
def wal_recovery_report(spark, sf_dir):
    return wal.recovery_report(_segments(spark, sf_dir, _damaged(spark, sf_dir))).select("records", "tail_segment", "stop_reason")


# --- measurement -------------------------------------------------------------------------

_Q = (0.0, 0.5, 0.9, 0.99, 1.0)


@query("SELECT event_type, " + ", ".join(f"quantile_disc(value, {q}) AS p{int(q * 100)}" for q in _Q) + " FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return measure.quantiles(_read(spark, sf_dir, "events"), "value", _Q, "event_type")


@query("SELECT event_type, min(v) AS min_ns, max(v) AS max_ns, coalesce(sum(v) // count(*), 0)::BIGINT AS mean_ns FROM (SELECT event_type, floor(value * 1000)::BIGINT AS v FROM events) GROUP BY event_type")
def latency_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).alias("v"))
    return measure.summary(rows, "v", "event_type")


@query("SELECT event_type, count(*) AS ops, CASE WHEN secs <= 0 THEN 0.0 ELSE count(*) / secs END AS per_s FROM events, (SELECT date_diff('second', min(ts), max(ts))::DOUBLE AS secs FROM events) GROUP BY event_type, secs")
def throughput(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    secs = e.agg(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).cast("double").alias("secs"))
    return measure.throughput(e.join(F.broadcast(secs)), "secs", "event_type")


@query("SELECT c_custkey AS i, upper(lpad(to_hex(c_custkey), 32, '0')) AS key_hex FROM customer")
def gen_keys(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.hex(encoding.bench_key(F.col("c_custkey"))).alias("key_hex"))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT least(c_custkey // greatest(n // 7, 1), 6) AS worker, count(*) AS keys FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS c_custkey FROM customer), n GROUP BY 1")
def work_partition(spark, sf_dir):
    numbered = R.assign_seq(_read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 0).select(F.col("seq").alias("i"))
    return measure.work_partition(numbered, "i", 7).groupBy("worker").agg(F.count("*").alias("keys"))


# --- streaming ----------------------------------------------------------------------------


def _streamed(spark, sf_dir, run):
    """Run a stream over the events table to its end and return what it left."""
    base = _scratch(spark, "stream")
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    single = source.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", single[2] if not _is_dir(spark, source) else "*.parquet").parquet(single[0] if not _is_dir(spark, source) else source)
    return run(stream, base)


def _is_dir(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def stream_newest(spark, sf_dir):
    """Newest-wins state of a stream, in complete mode; each batch writes the state to the shared folder."""

    def run(stream, base):
        done = []

        def keep(state, number):
            state.write.mode("overwrite").parquet(f"{base}/state/{number}")
            done.append(number)

        ingest.newest(ingest.as_log(stream)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/state/{max(done)}")

    return _streamed(spark, sf_dir, run)


@query(EV + NEW + " SELECT key, value FROM newest WHERE tag = 1")
def stream_into_table(spark, sf_dir):
    """Micro-batches committed to a table, then a scan of it."""

    def run(stream, base):
        table = KvTable(spark, f"{base}/table", "bigint", "double", Options(bloom=False))
        ingest.into_table(ingest.as_log(stream), table, f"{base}/cp", availableNow=True).awaitTermination()
        return table.refresh().scan(ordered=False)

    return _streamed(spark, sf_dir, run)


@query(EV + NEW + " SELECT key, value FROM newest WHERE tag = 1")
def group_commit_replay(spark, sf_dir):
    """A stream into a table with group commit, stopped and started again from its checkpoint by a new handle."""

    def run(stream, base):
        for _ in range(2):
            table = KvTable(spark, f"{base}/table", "bigint", "double", Options(durability=Durability.GROUP_COMMIT, bloom=False))
            ingest.into_table(ingest.as_log(stream), table, f"{base}/cp", availableNow=True).awaitTermination()
        return KvTable(spark, f"{base}/table", "bigint", "double").scan(ordered=False)

    return _streamed(spark, sf_dir, run)


@query("SELECT c_custkey AS i, upper(lpad(to_hex(c_custkey), 32, '0')) AS key_hex, 100::BIGINT AS bytes, (c_custkey * 21) % 256 AS pattern FROM customer")
def gen_values(spark, sf_dir):
    """Keys and values of the workload: the number, then bytes that count up from a seed."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    value = encoding.bench_value(F.col("i"))
    pattern = F.conv(F.substr(F.hex(value), F.lit(17), F.lit(2)), 16, 10).cast("bigint")
    return c.select("i", F.hex(encoding.bench_key(F.col("i"))).alias("key_hex"), F.octet_length(value).cast("bigint").alias("bytes"), pattern.alias("pattern"))


@query(
    _BYTES + NEW + ", r AS (SELECT DISTINCT substr(key, 1, 2) AS lo, substr(key, 1, 2) || '80' AS hi FROM log)"
    " SELECT lo AS range_hex, count(*) AS pairs, min(key) AS first_hex, max(key) AS last_hex FROM r JOIN newest ON tag = 1 AND key >= lo AND key < hi GROUP BY lo"
)
def byte_multi_range(spark, sf_dir):
    """Many ranges of byte keys in one join: from a first byte to that byte and 0x80."""
    log = _byte_log(spark, sf_dir)
    lo = F.expr("substring(key, 1, 1)")
    windows = log.select(lo.alias("lo"), F.concat(lo, F.unhex(F.lit("80"))).alias("hi")).distinct()
    found = ranges.multi_range_ordered(R.live(log), windows).withColumn("h", F.hex("key"))
    return found.groupBy(F.hex("lo").alias("range_hex")).agg(F.count("*").alias("pairs"), F.min("h").alias("first_hex"), F.max("h").alias("last_hex"))


# --- the table's own reads and writes ---------------------------------------------------------


def _table(spark, sf_dir, what: str, durability: Durability = Durability.ALWAYS, **kw) -> KvTable:
    return KvTable(spark, _scratch(spark, what), "bigint", "double", Options(durability=durability, bloom=False, fanout=FANOUT, **kw))


@query(EV + NEW + " SELECT key, value FROM newest WHERE tag = 1 AND key > 10 AND key <= 90")
def memtable_range_snapshot(spark, sf_dir):
    """A range of batches that no table file holds and no snapshot has yet."""
    table = _table(spark, sf_dir, "memtable", Durability.BUFFERED)
    for i in range(2):
        table.append(ev(spark, sf_dir).where(F.col("seq") % 2 == i))
    return table.scan(10, 90, False, True, ordered=False)


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def memtable_full_snapshot(spark, sf_dir):
    """All pending batches, deletes included."""
    table = _table(spark, sf_dir, "memtable")
    for i in range(2):
        table.append(ev(spark, sf_dir).where(F.col("seq") % 2 == i))
    return table.resolved().select("key", "seq", F.col("tag").cast("int").alias("tag"), "value")


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def sstable_read(spark, sf_dir):
    """Every row of a table file as it was written: one version of a key, deletes included."""
    table = _table(spark, sf_dir, "sstable")
    table.append(ev(spark, sf_dir))
    table.flush()
    rows = spark.read.parquet(f"{table.root}/{table.version.tiers[0][0].path}")
    return rows.select("key", "seq", F.col("tag").cast("int").alias("tag"), "value")


@query(ORD + NEW + " SELECT c_custkey, value FROM customer LEFT JOIN (SELECT * FROM newest WHERE tag = 1) ON key = c_custkey")
def sstable_get(spark, sf_dir):
    """Point reads of a flushed table for every customer."""
    table = _table(spark, sf_dir, "sstable")
    table.append(ord_(spark, sf_dir))
    table.flush()
    return table.multi_get(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(
    EV + ", n AS (SELECT count(DISTINCT key) AS keys FROM log) SELECT mode, CASE mode WHEN 'always' THEN keys ELSE 0 END AS before_commit,"
    " CASE mode WHEN 'buffered' THEN 0 ELSE keys END AS after_commit, keys AS after_flush FROM n, (VALUES ('always'), ('group'), ('buffered')) m(mode)"
)
def durability_modes(spark, sf_dir):
    """The keys that another reader sees after an append, after the end of its group, and after a flush."""
    rows = []
    for mode in Durability:
        table = _table(spark, sf_dir, "modes", mode)
        seen = lambda t=table: KvTable(spark, t.root, "bigint", "double").resolved().count()
        table.append(ev(spark, sf_dir))
        before = seen()
        if mode is Durability.GROUP_COMMIT:
            table.commit()
        after = seen()
        table.flush()
        rows.append((mode.value, before, after, seen()))
    return spark.createDataFrame(rows, "mode string, before_commit bigint, after_commit bigint, after_flush bigint")


@query(EV + ", n AS (SELECT max(seq) AS top FROM log) SELECT top + 1 AS next_seq, 4::BIGINT AS next_table_id, 3::BIGINT AS tables, 1::BIGINT AS pending FROM n")
def manifest_reload(spark, sf_dir):
    """What a new handle loads from the newest snapshot after three flushes and an append."""
    table = _table(spark, sf_dir, "manifest")
    for i in range(4):
        table.append(ev(spark, sf_dir).where(F.col("seq") % 4 == i))
        if i < 3:
            table.flush()
    version = KvTable.open(spark, table.root, key_type="bigint", value_type="double").version
    return spark.createDataFrame([(version.next_seq, version.next_table_id, len(version.newest_first()), len(version.pending))], "next_seq bigint, next_table_id bigint, tables bigint, pending bigint")


@query(EV + ", k AS (SELECT DISTINCT key, seq % 2 AS part FROM log) SELECT 0 AS tier, part::INT AS pos, part + 1 AS id, count(*) AS num_entries, min(key) AS first_key, max(key) AS last_key FROM k GROUP BY part")
def introspection(spark, sf_dir):
    """describe() of a table of two flushes."""
    table = _table(spark, sf_dir, "describe")
    for i in range(2):
        table.append(ev(spark, sf_dir).where(F.col("seq") % 2 == i))
        table.flush()
    return table.describe()


@query(EV + " SELECT count(DISTINCT key) AS deleted, 0::BIGINT AS tables, 0::BIGINT AS left_over FROM log")
def empty_merge(spark, sf_dir):
    """Four tables of deletes only, merged with nothing below: no table is left."""
    table = _table(spark, sf_dir, "empty")
    log = ev(spark, sf_dir).withColumn("tag", F.lit(0)).withColumn("value", F.lit(None).cast("double"))
    for i in range(FANOUT):
        table.append(log.where(F.col("seq") % FANOUT == i))
        table.flush()
    return log.agg(F.countDistinct("key").alias("deleted")).select("deleted", F.lit(len(table.version.newest_first())).cast("bigint").alias("tables"), F.lit(table.log().count()).alias("left_over"))


@query(EV + NEW + " SELECT count(*) AS scanned, 0::BIGINT AS differ FROM newest WHERE tag = 1")
def scan_get_agreement(spark, sf_dir):
    """Every pair of a scan is what a point read of its key gives."""
    table = _table(spark, sf_dir, "agree")
    for i in range(3):
        table.append(ev(spark, sf_dir).where(F.col("seq") % 3 == i))
        if i < 2:
            table.flush()
    both = table.multi_get(table.scan(ordered=False), into="got")
    return both.agg(F.count("*").alias("scanned"), F.count_if(~F.col("got").eqNullSafe(F.col("value"))).alias("differ"))


@query(EV + " SELECT key, seq, tag, value FROM log WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def pinned_reader(spark, sf_dir):
    """A handle keeps its version while another writes, flushes and merges."""
    table = _table(spark, sf_dir, "pin")
    log = ev(spark, sf_dir)
    table.append(log.where("seq <= 500"))
    pinned = KvTable(spark, table.root, "bigint", "double")
    table.append(log.where("seq > 500"))
    table.flush()
    return pinned.resolved().select("key", "seq", F.col("tag").cast("int").alias("tag"), "value")


@query(EV + NEW + " SELECT key, seq, tag, value FROM newest")
def stream_stateful(spark, sf_dir):
    """The custom stateful operator: the last change that it emits for each key."""

    def run(stream, base):
        changes = ingest.newest_stateful(ingest.as_log(stream))
        changes.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
        return R.resolve(spark.read.parquet(f"{base}/out"))

    return _streamed(spark, sf_dir, run)


@query("SELECT c_custkey AS i, 'key' || lpad(c_custkey::VARCHAR, 12, '0') AS key, 'val-' || lpad(c_custkey::VARCHAR, 12, '0') || '-payload-padding-to-force-flushes-0123456789' AS value FROM customer")
def crash_pairs(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    key, value = encoding.crash_pair(F.col("i"))
    return c.select("i", F.decode(key, "utf-8").alias("key"), F.decode(value, "utf-8").alias("value"))


@query(
    "WITH h AS (SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') AS h FROM orders)"
    " SELECT o_orderkey, list_reduce(list_transform(range(8), lambda i: substr(h, 15 - 2 * i, 2)), lambda a, b: a || b) AS le_hex, o_orderkey AS back FROM h"
)
def little_endian_integers(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    le = encoding.little_endian(F.col("o_orderkey"), 8)
    return o.select("o_orderkey", F.hex(le).alias("le_hex"), encoding.number(le).alias("back"))


@query("SELECT o_orderkey, true AS moved_some FROM orders")
def fill_order(spark, sf_dir):
    """The seeded order of a fill: every key once, and not in key order."""
    numbered = R.assign_seq(_read(spark, sf_dir, "orders").select("o_orderkey", F.xxhash64("o_orderkey", F.lit(1729)).alias("h")), ["h", "o_orderkey"], 0)
    moved = numbered.agg((F.sum(F.abs(F.col("seq") - F.col("o_orderkey"))) > 0).alias("moved_some"))
    return numbered.select("o_orderkey").join(F.broadcast(moved))
