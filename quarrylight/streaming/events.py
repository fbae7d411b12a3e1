"""Streaming forms of the log and state operators: the batch results, kept up as rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A Parquet folder as a stream with its event time as a timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def with_event_time(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed_counts(events: DataFrame, key: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were not seen within the watermark: a fetch gate over a stream of URLs."""
    return events.dropDuplicatesWithinWatermark(keys)


def latest_status(batch_sink: Callable[[DataFrame, int], None], events: DataFrame, checkpoint: str):
    """Run ``batch_sink`` on each micro-batch until what is there has been read."""
    return events.writeStream.foreachBatch(batch_sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(path: str, events: DataFrame, checkpoint: str):
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
