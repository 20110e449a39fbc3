"""Structured Streaming over event files: windows, sessions, de-duplication and incremental indexing.

A run takes what is there (``availableNow``), keeps its place in a checkpoint folder and writes Parquet that all
executors see, so running it again takes only new files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwood.sources.scratch import folder

WATERMARK = "1 hour"


def source(spark: SparkSession, path: str, like: str | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path`` (with the schema of ``like``), with the event time as a timestamp."""
    schema = spark.read.parquet(like or path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    per = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    per = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", WATERMARK).dropDuplicates(["event_id"])


def taken(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its rows; ``complete`` replaces earlier results, ``append`` adds."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own files only.
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(stream.columns)


def index_incrementally(stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Adds ``build`` of each new batch to ``target``; a batch number is its part's name, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
