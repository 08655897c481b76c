"""A corpus from raw documents to token ids, in stages over the training-data operators.

Each stage gets the documents its predecessor kept; its result is written as
Parquet into the shared folder and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweft.llm import mixing, pii, sentencepiece_sa, simhash, toxicity
from tallyweft.llm.shared import cut
from tallyweft.storage import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labelled rows outside the held-out fold."""
    ship(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    ship(spark)
    return simhash.keep_one(docs)


def protect_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; ``n_chars`` follows the new text."""
    out = pii.protect(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each document of the mix."""
    ship(spark)
    return sentencepiece_sa.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_copies),
    ("private_values", protect_private),
    ("source_mix", mix_sources),
    ("token_ids", tokenize),
]

#: Neither zstandard lengths nor keyed networks have a counterpart in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
