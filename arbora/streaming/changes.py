"""Streams of changed files: extraction again on arrival, and windowed counts of events with late data.

An extension: the engine's queries are batch. A stream of (path, content, changed_at) rows keeps a stored table
of facts up to date, a batch at a time; a batch that runs twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    return batch.groupBy("path").agg(F.max_by("content", "changed_at").alias("content"), F.max("changed_at").alias("changed_at"))


def refresh(extract, table: str):
    """A foreachBatch function: facts of a batch's paths go to ``table`` in a folder of the batch's number, so
    a repeated batch overwrites itself. ``extract`` maps files to facts."""
    def run(batch: DataFrame, number: int) -> None:
        now = latest(batch)
        facts = extract(now.select("path", "content")).withColumn("batch", F.lit(number).cast("long"))
        facts.write.mode("overwrite").parquet(f"{table}/facts/batch={number}")
        now.select("path", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{table}/paths/batch={number}")
    return run


def current_facts(spark, table: str) -> DataFrame:
    """Facts of each path as of the last batch that had it."""
    last = spark.read.parquet(f"{table}/paths").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{table}/facts").join(last, ["path", "batch"], "left_semi").drop("batch")


def changes_per_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Changed files a window, with a watermark for late ones."""
    return stream.withWatermark("changed_at", late).groupBy(F.window("changed_at", window)).agg(F.count(F.lit(1)).alias("n_changes"), F.approx_count_distinct("path").alias("n_paths"))
