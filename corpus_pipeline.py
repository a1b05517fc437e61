"""Corpus pipeline: language identification, near-duplicate removal, pseudonyms, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one.  All but the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import langid, packing, pii, simhash
from strandframe.llm.common import ensure_checkpoint_dir, table

#: The stages run in Python and hash with XXH64 and SHA-256, which SQL can't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter or with no likely language go."""
    return langid.accepted(docs, min_score=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pii.pseudonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they hand on lies in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
