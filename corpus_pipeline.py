"""Corpus pipeline: quality filter, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before kept; ``run`` writes each result as
Parquet below the shared checkpoint folder and reads it again, so a lost executor costs one stage. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontaminate, jaccard, mixing, quality, sharding
from tidepool.llm.columns import table
from tidepool.runtime import stage

# Near duplicates: five words, 80 %.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least its threshold)."""
    scored = quality.annotate(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of the Jaccard join: the one with the smallest id."""
    return jaccard.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("_found.hits") == 0).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (its passes: 0, 1 or 2)."""
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every remaining document, in 24 shards of near equal bytes."""
    return sharding.shard(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", source_mix), ("shards", shards)]

#: The classifier and the components have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
