"""Exact top-k search by inner product.

Queries come in blocks of bounded size, broadcast against all shards of the
candidates; one pass over a shard serves several blocks.  A task multiplies
tiles of queries with tiles of its shard, selects each query's best of a tile,
and merges them into its running lists; the lists of the tasks are merged in
two levels, first by query and salt, then by query.

A score is the exact inner product whatever the size of the components, or the
nearest long where that does not fit 64 bits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches

#: Queries of one broadcast block, blocks of one pass, queries of one tile, rows of one tile.
BLOCK_QUERIES, PASS_BLOCKS, TILE_QUERIES, TILE_ROWS = 8_192, 8, 512, 2_048
#: Salts of the first merge.
MERGE_SALTS = 8
SCALE = 1024.0
#: Components below this are scaled in 64 bits, others as Python integers.
_LARGE = float(1 << 52)
LISTS = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors as doubles; those with a null or non-finite component go."""
    v = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    )


def _scaled(x: float) -> int:
    """floor(1024 * x), exactly."""
    return int(x) << 10 if abs(x) >= _LARGE else math.floor(SCALE * x)


def _tiles(ids: np.ndarray, lists: pa.ListArray):
    """(dimension, ids, integer matrix) of the rows of each dimension, those with large components apart."""
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    large = np.zeros(len(size), dtype=bool)
    big = np.flatnonzero(np.abs(flat) >= _LARGE)
    large[np.searchsorted(at, big[(big >= at[0]) & (big < at[-1])], "right") - 1] = True
    for d in np.unique(size):
        for exact in (False, True):
            rows = np.flatnonzero((size == d) & (large == exact))
            if len(rows):
                x = flat[at[rows][:, None] + np.arange(d)]
                yield int(d), ids[rows], np.frompyfunc(_scaled, 1, 1)(x).astype(object) if exact else np.floor(SCALE * x).astype(np.int64)


def product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the ends of the range."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    return np.clip(q.astype(object) @ v.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k highest scores, ties to the smaller vec_id."""
    order = np.lexsort((vec, ~score, row))
    row, score, vec = row[order], score[order], vec[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    keep = rank < k
    return row[keep], score[keep], vec[keep]


def of_tile(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """The best k of one tile for each of its queries, without the query's own id."""
    s = product(q, v)
    other = ids[None, :] != queries[:, None]
    if len(ids) > k + 1:
        low = np.iinfo(np.int64).min
        masked = np.where(other, s, low)
        kth = np.partition(masked, len(ids) - k, axis=1)[:, len(ids) - k]
        row, col = np.nonzero((masked >= kth[:, None]) & other)
    else:
        row, col = np.nonzero(other)
    return best(row, s[row, col], ids[col], k)


def _search(blocks, k: int):
    def run(batches):
        tiles = [t for block in blocks for t in block.value]
        held = {i: (np.zeros(0, np.int64),) * 3 for i in range(len(tiles))}
        for batch in batches:
            for d, own, v in _tiles(batch.column(0).to_numpy(), batch.column(1)):
                for i, (dim, names, q) in enumerate(tiles):
                    if dim != d:
                        continue
                    for a in range(0, len(own), TILE_ROWS):
                        new = of_tile(names, q, own[a : a + TILE_ROWS], v[a : a + TILE_ROWS], k)
                        held[i] = best(*(np.concatenate(x) for x in zip(held[i], new, strict=True)), k)
        for i, (row, score, vec) in held.items():
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(tiles[i][1][row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows.

    Scores are inner products of floor(1024 * x), or the nearest long where
    that does not fit 64 bits; ties go to the smaller vec_id.  Vectors that are null or hold a null or non-finite component take
    no part; only vectors of equal length are compared, empty ones too.  Rows
    that share the query's vec_id are its own.  Of queries that repeat an id
    the smallest vector counts; candidates that repeat an id each take a rank.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.persist()
    total = asked.count()
    blocks = -(-total // BLOCK_QUERIES)
    rows = usable(vectors, id_col, vector_col)
    sent = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        tiles = []
        for d, ids, q in _tiles(part.column("vec_id").to_numpy(), part.column("v").combine_chunks()):
            tiles += [(d, ids[a : a + TILE_QUERIES], q[a : a + TILE_QUERIES]) for a in range(0, len(ids), TILE_QUERIES)]
        sent.append(spark.sparkContext.broadcast(tiles))
    asked.unpersist()
    lists = [rows.mapInArrow(_search(sent[b : b + PASS_BLOCKS], k), LISTS) for b in range(0, blocks, PASS_BLOCKS)]
    if not lists:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("vec_id")]
    merged = reduce(DataFrame.unionByName, lists).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(MERGE_SALTS)))
    merged = merged.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("r") <= k)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
