"""Sequential folds over a table's entries: block packing and freeze points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

BLOCK_BYTES = 4096


def fold(lengths, limit: int, after: bool) -> list[int]:
    """The number of the block, or batch, that each entry goes to.

    With ``after`` a batch ends with the entry that brings it to ``limit``
    bytes or more; without, a block ends before the entry that would bring it
    beyond, and an entry larger than the limit has a block of its own.
    """
    out, number, used = [], 0, 0
    for n in lengths:
        if not after and used and used + n > limit:
            number, used = number + 1, 0
        out.append(number)
        used += n
        if after and used >= limit:
            number, used = number + 1, 0
    return out


def pack(entries: DataFrame, table: str, key: str, length: str, limit: int = BLOCK_BYTES, after: bool = False) -> DataFrame:
    """(table, block, entries, first_key, last_key, bytes) of every table.

    The accumulator resets, so this is no window; each table is folded by one
    task, and a table is bounded by the flush size.
    """
    kind = entries.schema[key].dataType.simpleString()
    id_kind = entries.schema[table].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        pdf["block"] = fold(pdf[length].tolist(), limit, after)
        got = pdf.groupby("block", as_index=False).agg(entries=(key, "size"), first_key=(key, "first"), last_key=(key, "last"), bytes=(length, "sum"))
        got.insert(0, table, pdf[table].iloc[0])
        return got

    return entries.select(table, key, length).groupBy(table).applyInPandas(run, f"`{table}` {id_kind}, block bigint, entries bigint, first_key {kind}, last_key {kind}, bytes bigint")
