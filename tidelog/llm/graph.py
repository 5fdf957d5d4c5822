"""Connected components by alternating large-star and small-star rounds.

Each round is a partial aggregation and an equi-join on a vertex, so a
vertex with very many neighbours is pre-aggregated before the shuffle and
its join partition can be split by AQE.  Before the rounds every partition
contracts its own edges to stars, which usually leaves nothing to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


#: Edges that one contraction holds at a time.
CONTRACT_EDGES = 1 << 20


def _stars(edges: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) for the nodes of some edges."""
    names, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape)
    low = np.arange(len(names))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        low = low[low]
        if (low == before).all():
            break
    keep = low != np.arange(len(names))
    return np.stack([names[keep], names[low[keep]]])


def _contract(batches):
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            n += batch.num_rows
        if n >= CONTRACT_EDGES:
            yield _edges(_stars(np.concatenate(held, axis=1)))
            held, n = [], 0
    if held:
        yield _edges(_stars(np.concatenate(held, axis=1)))


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["hi", "lo"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return rest.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether every hi has one lo and no lo is a hi."""
    ends = e.select(F.col("hi").alias("v"), "lo").unionByName(e.select(F.col("lo").alias("v"), F.lit(None).cast("bigint").alias("lo")))
    bad = ends.groupBy("v").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.max(F.col("lo").isNull()).alias("low")).where("least < most or (low and least is not null)")
    return bad.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on some edge; root is the smallest node.

    Null ends and loops are ignored; repeated edges are harmless; without
    edges the result is empty.  Contracted edges are read by as few tasks as
    can hold them, CONTRACT_EDGES each; one task leaves nothing but stars.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = cut(e.mapInArrow(_contract, "hi bigint, lo bigint"))
    while True:
        tasks = -(-e.count() // CONTRACT_EDGES)
        if tasks <= 1:
            e = cut(e.coalesce(1).mapInArrow(_contract, "hi bigint, lo bigint"))
            break
        if _is_stars(e):
            break
        e = cut(_small_star(_large_star(e)).coalesce(tasks).mapInArrow(_contract, "hi bigint, lo bigint").distinct())
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
