"""A corpus pipeline: language ID, line dedup, near-dedup, secret masking, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each as Parquet in the shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id, line_dedup, near_dedup, packing, secrets
from weftline.llm.common import scratch, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language to be told (no text, or no letter in it) go; the others get the language found.

    Where no profile could be learned they keep their own.
    """
    profiles = language_id.learn(docs)
    if not profiles:
        return language_id.readable(docs.select(*COLUMNS))
    found = language_id.predict(docs, profiles).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them only."""
    return _counted(line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return _counted(secrets.mask_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: MinHash, tokens and rank-order profiles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{root}/stage-{k}")
    return docs
