"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.session import cut, partitions, shared_dir

__all__ = ["bounded_batches", "cut", "ddl", "marked", "partitions", "scratch", "shared_dir", "table", "texts"]

#: Rows of one Arrow batch.  Documents can be very long, so a batch of the
#: default 10,000 rows could outgrow a Python worker.
BATCH_ROWS = 1024
#: Bits of the bitmap of wanted keys.
MARK_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidelog-{what}-{uuid.uuid4().hex}"


def marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with a flag ``marked``: true for every key that is wanted, and for few others while few are.

    The flags are bits of a bitmap of fixed size, 4 KiB for each of at most
    MARK_BITS / 32,768 rows and 4 MiB together, so it may be broadcast.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    bucket, place = F.floor(bit / 32768), (bit % 32768).cast("int")
    marks = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(marks), "_bucket", "left")
    return found.select(*rows.columns, F.coalesce(F.call_function("shiftright", byte, place % 8) % 2 == 1, F.lit(False)).alias("marked"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, text) with the text of a null row empty.

    With ``carry`` all other columns, and the id as it was, come along in one
    struct column ``row``, so that no name can clash with an operator's own.
    """
    own = [F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    if carry:
        own.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    return docs.select(*own)


def ddl(df: DataFrame, *names: str) -> str:
    """The DDL of some columns of a frame."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
