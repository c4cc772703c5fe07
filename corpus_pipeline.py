"""A corpus pipeline: language, quality, near duplicates, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaestor.llm import langid, minmax, packing, resampling
from quaestor.llm.common import Stash, small_batches
from quaestor.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language prediction by partial matching can tell; those without a letter go."""
    small_batches(spark)
    return langid.accepted(docs, docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, with good labelled documents as the target."""
    small_batches(spark)
    return resampling.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return minmax.deduplicated(docs, n=5, percent=80)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in windows of the sources' own proportions, with their ids."""
    small_batches(spark)
    return packing.packed(docs, vocabulary())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing_)]

#: SQL can't express the stages: they learn models and encode by a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to the shared folder and read again."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
