"""Continuous ingest: newest-wins state, and micro-batches into a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators import resolve as R
from tidelog.plans.table import CommitConflictError, KvTable


def newest(stream: DataFrame, *keys: str) -> DataFrame:
    """The newest version of every key, deletes included, for complete or update mode.

    Deletes stay in the state for good: a late put with a smaller sequence
    number must not bring a deleted key back.  In update mode the sink applies
    them.
    """
    return R.resolve(stream, *keys)


def newest_stateful(stream: DataFrame, key_type: str = "bigint", value_type: str = "double") -> DataFrame:
    """The same in append mode: every change of a key's newest version, in order.

    A row is emitted whenever a micro-batch holds a version newer than the
    state; equal sequence numbers keep the state.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        best = state.get if state.exists else None
        changed = False
        for pdf in batches:
            row = pdf.loc[pdf["seq"].idxmax()]
            if best is None or int(row["seq"]) > best[0]:
                value = row["value"]
                best, changed = (int(row["seq"]), int(row["tag"]), None if pd.isna(value) else value), True
        if changed:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "tag": [best[1]], "value": [best[2]]})

    return stream.select("key", "seq", "tag", "value").groupBy("key").applyInPandasWithState(
        step, f"key {key_type}, seq bigint, tag int, value {value_type}", f"seq bigint, tag int, value {value_type}", "append", GroupStateTimeout.NoTimeout
    )


def into_table(stream: DataFrame, table: KvTable, checkpoint: str, flush_every: int = 16, **trigger) -> StreamingQuery:
    """Append every micro-batch of log rows to a table, one commit each.

    A batch is published before the stream's checkpoint counts it as done,
    whatever the table's durability; another writer's commit in between only
    makes it try again.  A batch that is replayed after a failure is harmless:
    resolution goes by sequence number.  ``trigger`` is passed to the writer,
    for example ``availableNow=True``; back-pressure is the source's batch size.
    """

    def publish(batch: DataFrame, number: int) -> None:
        table.stage(batch)
        while True:
            try:
                table.refresh().commit()
                break
            except CommitConflictError:
                continue
        if number % flush_every == flush_every - 1:
            table.flush()

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**trigger).start() if trigger else writer.start()


def as_log(events: DataFrame) -> DataFrame:
    """Events of the driver's table as log rows of their users."""
    deleted = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(deleted, 0).otherwise(1).alias("tag"),
        F.when(~deleted, F.col("value")).alias("value"),
    )
