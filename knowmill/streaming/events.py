"""Streams of events: the batch operators' windows with watermarks. Extensions; there is no counterpart in batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowmill.sources.files import EVENT


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files as they appear, with ``time`` from their ts; lines without one are left out."""
    raw = spark.readStream.schema(EVENT).json(path)
    return raw.withColumn("time", F.try_to_timestamp("ts")).where("time is not null")


def windowed(events: DataFrame, window: str = "1 day", late: str = "1 day", time: str = "time") -> DataFrame:
    """Counts and costs by window and operation; a window closes when the watermark passes it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "op").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd")).select(F.col("w.start").alias("start"), "op", "n_events", "cost_usd")


def once(events: DataFrame, key: str, late: str = "1 day", time: str = "time") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sink(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A resumable file sink, run over what is there and stopped."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
