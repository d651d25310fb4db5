"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark overlap, token ids.

Null and empty texts score like any other and have no words, so no stage after the classifier drops them. Rows with one id
are one document to the near duplicates (all stay or all go) and don't cut each other's passages; elsewhere they
stay apart. A null id stands for itself. Empty ``documents`` give no rows; with empty ``labels`` every score is one half, so
all stay; with an empty ``benchmark`` all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoded
from tessera.llm.common import materialize
from tessera.llm.decontaminate import without_contaminated
from tessera.llm.minhash import without_near_duplicates
from tessera.llm.quality import without_rejected
from tessera.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group linked by five-word shingles at a similarity of 0.8."""
    return without_near_duplicates(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 13 words or more that a smaller document has."""
    return without_repeats(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark: one item is enough to go, however long the document."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as their number and digests."""
    return encoded(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_duplicates), ("substring dedup", repeats), ("benchmark decontamination", decontamination), ("bpe encoding and decoding", tokens)]

#: The classifier and the encoder can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
