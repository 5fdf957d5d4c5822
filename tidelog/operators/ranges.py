"""Key ranges: inclusive, exclusive and open bounds, and many ranges at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.session import cut, partitions


@dataclass(frozen=True)
class Range:
    """A key range; a bound of None is open.  Crossed bounds hold nothing."""

    lo: object = None
    hi: object = None
    lo_incl: bool = True
    hi_incl: bool = False

    def contains(self, key: str | Column = "key") -> Column:
        key = F.col(key) if isinstance(key, str) else key
        out = F.lit(True)
        if self.lo is not None:
            out = out & (key >= F.lit(self.lo) if self.lo_incl else key > F.lit(self.lo))
        if self.hi is not None:
            out = out & (key <= F.lit(self.hi) if self.hi_incl else key < F.lit(self.hi))
        return out

    def meets(self, first: str = "first_key", last: str = "last_key") -> Column:
        """Whether a table whose keys lie in [first, last] can hold keys of the range."""
        out = F.lit(True)
        if self.lo is not None:
            out = out & (F.col(last) >= F.lit(self.lo) if self.lo_incl else F.col(last) > F.lit(self.lo))
        if self.hi is not None:
            out = out & (F.col(first) <= F.lit(self.hi) if self.hi_incl else F.col(first) < F.lit(self.hi))
        return out


def scan(log: DataFrame, r: Range) -> DataFrame:
    """The rows of a log whose keys lie in the range; goes before resolution."""
    return log.where(r.contains())


def multi_range(rows: DataFrame, ranges: DataFrame, width: int, key: str = "key") -> DataFrame:
    """Rows joined with every half-open range [lo, hi) of an integer key.

    Each range is spread over the buckets of ``width`` keys that it touches,
    so the join is an equi-join on the bucket and a filter.
    """
    spread = ranges.where("lo < hi").withColumn("_b", F.explode(F.expr(f"sequence(floor(lo / {width}), floor((hi - 1) / {width}))")))
    rows = rows.withColumn("_b", F.floor(F.col(key) / width))
    return rows.join(spread, "_b").where((F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))).drop("_b")


def _bucket(key: Column, splits: list) -> Column:
    """The number of splits that are not above the key, as a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(key < F.lit(splits[m]), tree(a, m)).otherwise(tree(m + 1, b))

    return tree(0, len(splits))


def multi_range_ordered(rows: DataFrame, ranges: DataFrame, key: str = "key", buckets: int = 128, sample: int = 10_000) -> DataFrame:
    """Rows joined with every half-open range [lo, hi) of a key of any ordered type, such as bytes.

    A bounded sample of the rows' keys gives the borders of the buckets; it
    sways the balance only, not the result.  Each range is spread over the
    buckets that it touches, so the join is an equi-join and a filter.
    """
    some = sorted({r[0] if not isinstance(r[0], bytearray) else bytes(r[0]) for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).collect()})
    splits = sorted({some[len(some) * i // buckets] for i in range(1, buckets)}) if some else []
    spread = ranges.where("lo < hi").withColumn("_b", F.explode(F.sequence(_bucket(F.col("lo"), splits), _bucket(F.col("hi"), splits))))
    found = rows.withColumn("_b", _bucket(F.col(key), splits)).join(spread, "_b")
    return found.where((F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))).drop("_b")


def last_at_most(probes: DataFrame, firsts: DataFrame, probe: str, first: str, out: str) -> DataFrame:
    """For every probe the greatest ``first`` that is not above it, or null.

    A union sorted by value with a running maximum: the sparse-index lookup
    without a range join.  Range partitions keep it distributed; each carries
    the greatest first key of those before it.
    """
    kind = probes.schema[probe].dataType
    both = probes.select(F.col(probe).alias("_v"), F.lit(1).alias("_k"), F.struct(*probes.columns).alias("_row"))
    empty = F.lit(None).cast(both.schema["_row"].dataType)
    both = both.unionByName(firsts.select(F.col(first).cast(kind).alias("_v"), F.lit(0).alias("_k"), empty.alias("_row")))
    # The bounds of a range partitioning are sampled anew by every job, so it is fixed first.
    both = cut(both.repartitionByRange(partitions(probes.sparkSession), "_v", "_k").withColumn("_p", F.spark_partition_id()))
    heads = both.groupBy("_p").agg(F.max(F.when(F.col("_k") == 0, F.col("_v"))).alias("_m"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_p", F.max("_m").over(earlier).alias("_before"))
    within = Window.partitionBy("_p").orderBy("_v", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = both.withColumn("_here", F.max(F.when(F.col("_k") == 0, F.col("_v"))).over(within)).where("_k = 1")
    return ran.join(F.broadcast(heads), "_p").select("_row.*", F.coalesce("_here", "_before").alias(out))
