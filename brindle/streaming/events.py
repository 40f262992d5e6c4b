"""Structured Streaming over the event stream. These are additions of our own: the batch engine has no streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
LATENESS = "1 hour"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The event files of a folder as a stream with a watermark."""
    rows = spark.readStream.schema(EVENT).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def windows(events: DataFrame, length: str = "1 day", step: str | None = None) -> DataFrame:
    """Counts and sums per window and type; events that come twice count once."""
    once = events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    window = F.window("ts", length, step) if step else F.window("ts", length)
    counted = once.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand each micro-batch to a batch function (an upsert, say)."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def with_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Streams that start inside keep their state in a store of this kind."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)
