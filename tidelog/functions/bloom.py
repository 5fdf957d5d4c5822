"""Bloom filters as Spark expressions: sizing, probes, building, membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter that are kept in one row.
WORD = 1 << 15


def size(n: int, bits_per_key: int = 10) -> tuple[int, int]:
    """(bits, probes) for n keys; bits are whole bytes and at least 64."""
    n = max(1, n)
    bits = -(-max(64, n * bits_per_key) // 8) * 8
    return bits, min(30, max(1, math.floor(bits / n * math.log(2) + 0.5)))


def size_columns(n: Column, bits_per_key: int = 10) -> tuple[Column, Column]:
    """size() for a column of key counts."""
    n = F.greatest(F.lit(1), n)
    bits = F.ceil(F.greatest(F.lit(64), n * bits_per_key) / 8) * 8
    probes = F.least(F.lit(30), F.greatest(F.lit(1), F.floor(bits / n * math.log(2) + 0.5)))
    return bits.cast("bigint"), probes.cast("bigint")


def probes(key: Column, bits: int, k: int) -> Column:
    """The k bit positions of a key, by double hashing."""
    step = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    first = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(first + i * step, F.lit(bits)))


def build(keys: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """(bucket, bitmap): the filter in words of WORD bits, each one binary row."""
    at = keys.select(F.explode(probes(F.col(key), bits, k)).alias("at"))
    return at.select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def may_contain(rows: DataFrame, key: str, bloom: DataFrame, bits: int, k: int, out: str = "maybe") -> DataFrame:
    """Rows with a flag that is true for every key of the filter, and for few others.

    Each probe is an equi-join with the word that holds its bit; the rows of
    one input row are put together again by a partial aggregation.
    """
    asked = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_at", F.explode(probes(F.col(key), bits, k)))
    asked = asked.withColumn("bucket", F.bitmap_bucket_number("_at")).withColumn("_bit", F.bitmap_bit_position("_at"))
    found = asked.join(bloom, "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")), F.lit(0)) > 0
    return found.groupBy("_row", *rows.columns).agg(F.min(hit.cast("int")).alias("_all")).select(*rows.columns, (F.col("_all") == 1).alias(out))


def theory(n: int, bits: int, k: int) -> float:
    """The expected share of false positives."""
    return (1 - math.exp(-k * n / bits)) ** k
