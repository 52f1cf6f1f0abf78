"""Event-time windows, batch and streaming. An extension: the reference has no event-time features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], time: str = "ts") -> DataFrame:
    out = events.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n", "hi")


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], time: str = "ts") -> DataFrame:
    out = events.groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    out = events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def stream_tumbling(spark: SparkSession, path: str, width: str) -> DataFrame:
    """The same counts by Structured Streaming: the file as a stream, all data at once, complete mode."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, so that a single file will do
    timed = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    name = "stream_" + uuid.uuid4().hex
    run = counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
