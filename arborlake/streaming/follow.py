"""Following a store's new commits as a stream (an extension; the model itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow_commits(spark: SparkSession, path: str, schema: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of the commits appended under ``path`` as Parquet, each checksum once within the delay; ``schema`` has checksum, ref, ts (epoch seconds)."""
    stream = spark.readStream.schema(schema).parquet(path).withColumn("event_time", F.timestamp_seconds("ts"))
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["checksum"])


def commits_per_window(commits: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, ref, n): commits of each ref in windows of event time."""
    return commits.groupBy(F.window("event_time", width), "ref").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "ref", "n")
