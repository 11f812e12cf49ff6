"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import common, decontaminate, linededup, mixing, ngramjoin, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go; a document without any line left goes too."""
    out = linededup.dedup_lines(docs)
    return out.filter("line_dedup.n_kept > 0 or line_dedup.n_lines = 0").drop("line_dedup")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngramjoin.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows taken, and how many words of each."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", jaccard_stage), ("decontaminate", benchmark_stage), ("mixing", mixing_stage)]
#: The classifier and the components of near copies have no SQL form; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
