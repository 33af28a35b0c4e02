"""Structured Streaming forms of the time-based reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of a folder of Parquet files as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts by hour. A result is final an hour after its end: till then late events change it."""
    e = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    by = e.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return by.select(F.col("w.start").alias("hour"), "jobs", "failed")


def user_sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with pauses below the gap: how long a turn's state lives when each use prolongs it."""
    e = events.withColumn("at", F.col(time).cast("timestamp"))
    e = e.withWatermark("at", gap) if e.isStreaming else e
    s = e.groupBy(user, F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("w.start").alias("first"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("last"), "n")


def first_of_key(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is and returns the result."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
