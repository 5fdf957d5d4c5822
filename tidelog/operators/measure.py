"""Measurement: exact quantiles, summaries, throughput, work partition, order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.session import cut, partitions


def quantiles(samples: DataFrame, value: str, qs, *by: str) -> DataFrame:
    """Nearest-rank quantiles, named p0 to p100; q is clamped to [0, 1].

    Samples of several workers are quantiled together, never averaged.
    """
    aggs = [F.expr(f"percentile_disc({min(1.0, max(0.0, q))}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{int(q * 100)}") for q in qs]
    return samples.groupBy(*by).agg(*aggs)


def summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Minimum, maximum and floored integer mean; 0 for no samples."""
    zero = F.lit(0).cast("bigint")
    mean = F.expr(f"cast(sum(cast(`{value}` as decimal(38,0))) div count(`{value}`) as bigint)")
    return samples.groupBy(*by).agg(F.coalesce(F.min(value), zero).alias("min_ns"), F.coalesce(F.max(value), zero).alias("max_ns"), F.coalesce(F.when(F.count(value) > 0, mean), zero).alias("mean_ns"))


def throughput(ops: DataFrame, secs: str, *by: str) -> DataFrame:
    """Operations a second, 0 where no time has passed."""
    return ops.groupBy(*by, secs).agg(F.count("*").alias("ops")).select(*by, "ops", F.when(F.col(secs) <= 0, 0.0).otherwise(F.col("ops") / F.col(secs)).alias("per_s"))


def work_partition(rows: DataFrame, i: str, workers: int) -> DataFrame:
    """Equal chunks of numbered rows; the last worker takes the remainder."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(total)).withColumn("worker", F.least(F.expr(f"`{i}` div greatest(_n div {workers}, 1)"), F.lit(workers - 1)).cast("bigint")).drop("_n")


def order_violations(rows: DataFrame, key: str) -> DataFrame:
    """One row: adjacent pairs of a scan that are not strictly ascending.

    Partitions of the sorted scan are compared within, and their ends with
    each other, so no task sees more than one partition.
    """
    parts = cut(rows.select(F.col(key).alias("k")).repartitionByRange(partitions(rows.sparkSession), "k").withColumn("p", F.spark_partition_id()))
    inner = parts.withColumn("b", F.lag("k").over(Window.partitionBy("p").orderBy("k"))).where("b >= k").agg(F.count("*").alias("v"))
    ends = parts.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    outer = ends.withColumn("b", F.lag("hi").over(Window.orderBy("p"))).where("b >= lo").agg(F.count("*").alias("v"))
    return inner.unionByName(outer).agg(F.sum("v").alias("violations"))


def shuffled(rows: DataFrame, i: str, seed: int) -> DataFrame:
    """A deterministic permutation of rows by a seeded hash."""
    return rows.orderBy(F.xxhash64(F.col(i), F.lit(seed)), i)
