"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and all but the last return the columns that they were given.  A null
text is an empty text from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, jaccard, pieces, pii, quality
from tidelog.llm.common import scratch, table
from tidelog.llm.queries import tokenizer_model


def _columns(docs: DataFrame, rows: DataFrame, length: bool = False) -> DataFrame:
    """The columns of ``docs`` from (text, row); with ``length`` n_chars is counted anew."""
    out = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if length and "n_chars" in docs.columns:
        out[docs.columns.index("n_chars")] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*out)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _columns(docs, quality.with_statistics(docs, carry=True).where(model.column() >= 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word Jaccard similarity 0.8, keep the smallest doc_id.

    A row goes if its own text is linked to a smaller doc_id, whatever other
    rows share its doc_id.  Rows that repeat the smallest doc_id of a group all
    stay, and so do rows without a doc_id.
    """
    joined = jaccard.jaccard_join(docs, k=5, percent=80, hashed=True)
    gone = joined.where("component_id < doc_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"] == gone["gone"]) & (text_hash == gone["gone_text"]), "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item or a long passage of one."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return _columns(docs, found.where(F.size("hits") == 0))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind and count n_chars anew."""
    return _columns(docs, pii.mask(docs), length=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the SentencePiece ids of every document left."""
    return pieces.encode(docs, tokenizer_model()).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece", tokenize),
]

#: The stages fit models and call a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs.write.parquet(path := scratch(spark, "stage"))
            docs = spark.read.parquet(path)
    return docs
