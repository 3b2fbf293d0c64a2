"""Incremental versions: counters over an event stream and a keyed store fed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import KeyedStore


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts by time window and key; works on batch and stream, late rows beyond the watermark are dropped by a stream."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", lateness) if events.isStreaming else rows
    out = rows.groupBy(F.window("__ts", width), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), key, "n")


def feed_store(stream: DataFrame, store: KeyedStore, checkpoint: str):
    """Adds a stream's rows to a store; a batch that is replayed adds nothing twice. Stops when the input is used up."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: store.add(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)
