"""Tiers of sorted tables: bookkeeping, compaction choice, tombstone rule.

A snapshot's tables are rows of (tier, pos, id, num_entries, first_key,
last_key).  Tier 0 is the youngest; within a tier a larger position is newer.
The functions on lists drive a table's own commits; those on DataFrames answer
the same questions about many tables or many lakes at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ranges import Range


@dataclass(frozen=True)
class TableMeta:
    id: int
    path: str
    num_entries: int
    first_key: object
    last_key: object


@dataclass(frozen=True)
class Version:
    """An immutable set of tables and the counters of the next seq and id.

    ``pending`` lists batches with the base of their numbers, None if these are final.
    """

    tiers: tuple[tuple[TableMeta, ...], ...] = ()
    next_seq: int = 1
    next_table_id: int = 1
    pending: tuple[tuple[str, int | None], ...] = ()

    def with_flush(self, table: TableMeta | None, next_seq: int) -> Version:
        """A table on top of tier 0; the pending batches are in it."""
        tiers = self.tiers or ((),)
        if table is not None:
            tiers = ((*tiers[0], table), *tiers[1:])
        used = max(self.next_table_id, table.id + 1 if table else 1)
        return Version(_trim(tiers), max(self.next_seq, next_seq), used, ())

    def with_compaction(self, tier: int, table: TableMeta | None) -> Version:
        """Tier ``tier`` emptied, its merged table on top of the next."""
        tiers = [*self.tiers, *[()] * (tier + 2 - len(self.tiers))]
        tiers[tier] = ()
        if table is not None:
            tiers[tier + 1] = (*tiers[tier + 1], table)
        used = max(self.next_table_id, table.id + 1 if table else 1)
        return replace(self, tiers=_trim(tuple(tiers)), next_table_id=used)

    def newest_first(self) -> list[TableMeta]:
        return [t for tier in self.tiers for t in reversed(tier)]

    def candidate(self, fanout: int) -> int | None:
        """The youngest tier with ``fanout`` tables or more."""
        return next((i for i, t in enumerate(self.tiers) if len(t) >= fanout), None)

    def is_bottom(self, tier: int) -> bool:
        """Whether a merge of ``tier`` may drop deletes: nothing older lies below,
        in the tier that the result goes to neither."""
        return not any(self.tiers[tier + 1 :])

    def rows(self) -> list[tuple]:
        return [(i, p, t.id, t.num_entries, t.first_key, t.last_key) for i, tier in enumerate(self.tiers) for p, t in enumerate(tier)]


def _trim(tiers: tuple) -> tuple:
    while tiers and not tiers[-1]:
        tiers = tiers[:-1]
    return tiers


# --- the same on DataFrames ----------------------------------------------------------


def table_meta(rows: DataFrame, table: str = "id", key: str = "key") -> DataFrame:
    """Entries (deletes included) and the key range of every table."""
    return rows.groupBy(table).agg(F.count("*").alias("num_entries"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def tier_layout(flushes: DataFrame, total: str, number: str = "flush_no", fanout: int = 4, levels: int = 16) -> DataFrame:
    """The tier that each of the first ``total`` flushes has reached by cascading merges.

    A group of fanout**t flushes is merged into tier t as soon as it is whole.
    """
    tier = F.lit(0)
    for t in range(1, levels):
        group = fanout**t
        tier = F.when(F.ceil(F.col(number) / group) * group <= F.col(total), F.lit(t)).otherwise(tier)
    return flushes.withColumn("tier", tier.cast("int"))


def tier_sizes(meta: DataFrame) -> DataFrame:
    return meta.groupBy("tier").agg(F.count("*").alias("tables"))


def candidate(meta: DataFrame, fanout: int = 4) -> DataFrame:
    """One row: the youngest full tier, or null."""
    return tier_sizes(meta).where(F.col("tables") >= fanout).agg(F.min("tier").alias("tier"))


def output_is_bottom(meta: DataFrame) -> DataFrame:
    """Per tier, whether every older tier is empty."""
    lowest = meta.agg(F.max("tier").alias("lowest"))
    return meta.select("tier").distinct().join(F.broadcast(lowest)).select("tier", (F.col("tier") >= F.col("lowest")).alias("is_bottom"))


def newest_first(meta: DataFrame) -> DataFrame:
    """Tables with their rank in age, the newest 1.  Metadata is small: one row per table."""
    return meta.withColumn("age_rank", F.row_number().over(Window.orderBy("tier", F.desc("pos"))))


def prune(meta: DataFrame, r: Range) -> DataFrame:
    """Tables whose key range meets the range."""
    return meta.where(r.meets())


def orphans(files: DataFrame, referenced: DataFrame, on: str = "id") -> DataFrame:
    """Files that no version refers to."""
    return files.join(referenced.select(on).distinct(), on, "left_anti")
