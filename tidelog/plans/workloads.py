"""Key/value workloads in bulk: fill, point reads and range scans, with a report.

``python -m tidelog.plans.workloads fill-random --keys 100000`` runs one and
prints a line a phase.  An operation here is one job over a batch of keys: the
latencies are those of batches, the throughput counts keys.
"""

from __future__ import annotations

import argparse
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import encoding
from tidelog.operators import measure
from tidelog.plans.table import Durability, KvTable, Options

REPORT = "phase string, engine string, concurrency int, ops bigint, secs double, throughput double, min_us double, mean_us double, p50_us double, p99_us double, max_us double"
WORKLOADS = ("fill-random", "fill-seq", "point-read", "scan")


@dataclass(frozen=True)
class Config:
    workload: str = "fill-random"
    durability: Durability = Durability.GROUP_COMMIT
    keys: int = 100_000
    #: Keys read; 0 stands for as many as there are.
    reads: int = 0
    #: Jobs that run at a time; writes are ordered, so only reads are concurrent.
    concurrency: int = 1
    batches: int = 10
    flush_bytes: int = 64 << 20
    seed: int = 1729


def pairs(spark: SparkSession, keys: int, random: bool, seed: int, first_seq: int = 1) -> DataFrame:
    """Log rows of all keys, numbered in the order in which they are written."""
    ids = spark.range(keys)
    order = F.xxhash64("id", F.lit(seed)) if random else F.col("id")
    batch = F.pmod(order, F.lit(1 << 20)) if random else F.col("id")
    return ids.select(encoding.bench_key(F.col("id")).alias("key"), (F.col("id") + first_seq).alias("seq"), F.lit(1).alias("tag"), encoding.bench_value(F.col("id")).alias("value"), batch.alias("at"))


def scan_window(keys: int) -> int:
    """Keys of one range scan."""
    return min(1000, max(1, keys // 100))


def report(spark: SparkSession, phase: str, c: Config, ops: int, secs: float, micros: list[int]) -> DataFrame:
    """One row of REPORT from the latencies of all workers together."""
    samples = spark.createDataFrame([(m,) for m in micros], "us bigint")
    q = measure.quantiles(samples, "us", (0.5, 0.99)).join(measure.summary(samples, "us"))
    f = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    rate = ops / secs if secs > 0 else 0.0
    return q.select(
        F.lit(phase).alias("phase"), F.lit("tidelog").alias("engine"), F.lit(c.concurrency).alias("concurrency"), F.lit(ops).cast("bigint").alias("ops"), F.lit(secs).alias("secs"), F.lit(rate).alias("throughput"),
        f("min_ns").alias("min_us"), f("mean_ns").alias("mean_us"), f("p50").alias("p50_us"), f("p99").alias("p99_us"), f("max_ns").alias("max_us"),
    )


def _timed(jobs: list[Callable[[], None]], concurrency: int) -> tuple[float, list[int]]:
    def one(job) -> int:
        t = time.perf_counter()
        job()
        return round((time.perf_counter() - t) * 1e6)

    began = time.perf_counter()
    with ThreadPoolExecutor(concurrency) as pool:
        micros = list(pool.map(one, jobs))
    return time.perf_counter() - began, micros


def _sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def run(spark: SparkSession, root: str, c: Config) -> DataFrame:
    """Fill a table at ``root``; for point reads and scans also flush and read it."""
    rows = pairs(spark, c.keys, c.workload != "fill-seq", c.seed)
    low, high = 0, (1 << 20) if c.workload != "fill-seq" else c.keys
    step = math.ceil((high - low) / c.batches)
    table = KvTable(spark, root, options=Options(durability=c.durability, flush_bytes=c.flush_bytes))
    parts = [rows.where(f"at >= {a} and at < {a + step}").drop("at") for a in range(low, high, step)]
    secs, micros = _timed([lambda p=p: table.append(p) for p in parts], 1)
    table.commit()
    out = report(spark, c.workload if c.workload.startswith("fill") else "fill", c, c.keys, secs, micros)
    if c.workload.startswith("fill"):
        return out
    table.flush()
    if c.workload == "point-read":
        n = c.reads or c.keys
        wanted = spark.range(n).select(encoding.bench_key(F.pmod(F.xxhash64("id", F.lit(c.seed + 1)), F.lit(c.keys))).alias("key"), F.pmod("id", F.lit(c.batches)).alias("b"))
        jobs = [lambda b=b: _sink(table.multi_get(wanted.where(f"b = {b}"))) for b in range(c.batches)]
    else:
        width, n = scan_window(c.keys), min(1000, c.batches)
        starts = [i * max(1, (c.keys - width) // n) for i in range(n)]
        key = lambda i: i.to_bytes(16, "big")
        jobs = [lambda a=a: _sink(table.scan(key(a), key(a + width))) for a in starts]
    secs, micros = _timed(jobs, c.concurrency)
    return out.unionByName(report(spark, c.workload, c, n, secs, micros))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("workload", nargs="?", choices=WORKLOADS, default="fill-random")
    p.add_argument("--durability", type=Durability.parse, default=Durability.GROUP_COMMIT)
    p.add_argument("--keys", type=int, default=100_000)
    p.add_argument("--reads", type=int, default=0)
    p.add_argument("--concurrency", type=int, default=1)
    p.add_argument("--batches", type=int, default=10)
    p.add_argument("--flush-bytes", type=int, default=64 << 20)
    p.add_argument("--dir", required=True)
    p.add_argument("--seed", type=lambda s: int(s, 0), default=1729)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tidelog-workloads").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    c = Config(a.workload, a.durability, a.keys, a.reads, a.concurrency, a.batches, a.flush_bytes, a.seed)
    for r in run(spark, a.dir, c).collect():
        print(f"{r.phase:<12} {r.engine} c={r.concurrency} ops={r.ops} secs={r.secs:.3f} ops/s={r.throughput:.0f} us: min={r.min_us:.0f} mean={r.mean_us:.0f} p50={r.p50_us:.0f} p99={r.p99_us:.0f} max={r.max_us:.0f}")


if __name__ == "__main__":
    main()
