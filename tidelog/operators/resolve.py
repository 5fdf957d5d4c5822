"""Newest-wins resolution of a sequence-numbered log.

A log has ``key``, ``seq``, ``tag`` (1 put, 0 delete) and value columns; the
version with the greatest ``seq`` of each key wins, whatever its source or
arrival order.  Deletes take part in the resolution and are hidden after it.
Predicates on keys may be applied before (Catalyst does so itself), those on
values only after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.session import cut, partitions

PUT, DELETE = 1, 0
#: Types that a hash aggregate can update in place.
_IN_PLACE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def resolve(log: DataFrame, *keys: str, seq: str = "seq", source: str | None = None) -> DataFrame:
    """One row per key: the version with the greatest ``seq``, deletes included.

    Partial aggregation runs before the shuffle, so a hot key costs one row
    per task.  If all values can be updated in place, each is kept by its own
    ``max_by`` and the plan is a hash aggregate; otherwise they are kept as
    one struct.  With ``source``, equal seqs go to the smaller source, and
    without it (key, seq) must be unique.  Rows with a null key or seq are
    refused by validate(); here a null seq loses against any other.
    """
    keys = keys or ("key",)
    rest = [c for c in log.columns if c not in keys and c not in (seq, source)]
    if source is None and all(isinstance(log.schema[c].dataType, _IN_PLACE) for c in rest):
        return log.groupBy(*keys).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in rest])
    order = F.col(seq) if source is None else F.struct(F.col(seq), (-F.col(source)).alias("_s"))
    best = log.groupBy(*keys).agg(F.max_by(F.struct(seq, *rest, *([source] if source else [])), order).alias("_v"))
    return best.select(*keys, "_v.*")


def resolve_window(log: DataFrame, *keys: str, seq: str = "seq", source: str | None = None) -> DataFrame:
    """The same rows by ranking; keeps wide rows in place of copying structs."""
    order = [F.col(seq).desc(), *([F.col(source)] if source else [])]
    w = Window.partitionBy(*(keys or ("key",))).orderBy(*order)
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def is_put() -> Column:
    return F.col("tag") == PUT


def hide_deletes(resolved: DataFrame) -> DataFrame:
    """Live rows of a resolved log, without the tag."""
    return resolved.where(is_put()).drop("tag")


def live(log: DataFrame, *keys: str, seq: str = "seq", source: str | None = None) -> DataFrame:
    """Keys whose newest version is a put, with that version."""
    return hide_deletes(resolve(log, *keys, seq=seq, source=source))


def tombstones(log: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Keys whose newest version is a delete."""
    return resolve(log, *keys, seq=seq).where(F.col("tag") == DELETE)


def as_of(log: DataFrame, n, seq: str = "seq") -> DataFrame:
    """The log as it was after the version ``n``."""
    return log.where(F.col(seq) <= n)


def prefix_counts(log: DataFrame, step: str, seq: str = "seq") -> DataFrame:
    """(step, live_keys) after every step of the log, steps being runs of sequence numbers.

    Each version adds or removes its key or changes nothing, so one pass over
    the keys gives all prefixes; only one row a step is summed up in order.
    """
    before = F.lag("tag", 1, DELETE).over(Window.partitionBy("key").orderBy(seq))
    changes = log.withColumn("_d", F.col("tag") - before).groupBy(step).agg(F.sum("_d").alias("_d"))
    return changes.select(step, F.sum("_d").over(Window.orderBy(step)).cast("bigint").alias("live_keys"))


def union(*sources: DataFrame) -> DataFrame:
    """All sources as one log, each row with the index of its source."""
    out = sources[0].withColumn("source", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source", F.lit(i)))
    return out


def insert_if_newer(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Resolved state after conditional upserts: an equal seq keeps the existing row."""
    return resolve(union(existing, incoming), *keys, source="source").drop("source")


def validate(log: DataFrame) -> DataFrame:
    """Fails at run time on null keys or seqs, negative seqs and tag/value mismatch."""
    ok = F.col("key").isNotNull() & F.col("seq").isNotNull() & (F.col("seq") >= 0) & F.col("tag").isin(PUT, DELETE)
    if "value" in log.columns:
        ok = ok & ((F.col("tag") == DELETE) == F.col("value").isNull())
    said = F.concat(F.lit("invalid log row at seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))
    return log.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")))


def assign_seq(rows: DataFrame, order_by: list[str], base: int = 1) -> DataFrame:
    """Consecutive sequence numbers from ``base`` in the order of ``order_by``.

    A source that has a total order of its own should use that.  Here rows are
    range-partitioned and numbered within partitions; only one count per
    partition reaches the driver.
    """
    # The bounds of a range partitioning are sampled anew by every job, so it is fixed first.
    parts = cut(rows.repartitionByRange(partitions(rows.sparkSession), *order_by).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order_by)))
    return ranked.join(F.broadcast(starts), "_p").withColumn("seq", (F.col("_start") + F.col("_r") + (base - 1)).cast("bigint")).drop("_p", "_r", "_start")
