"""Structured Streaming forms: ingest with validation, depth by window, islands by session, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream, at most `files` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, at_once: bool = True) -> StreamingQuery:
    """Appends the stream to a Parquet table; a restart goes on from the checkpoint without loss or repeats."""
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if at_once else w).start()


def windowed(events: DataFrame, ts: str, key: str, every: str, late: str) -> DataFrame:
    """(key, bgn, n): rows of each key by windows of `every`; rows later than `late` are dropped once their window is closed."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, every), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col(key).alias("key"), F.col("window.start").alias("bgn"), "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, bgn, end, n): the islands of each key's rows, apart by `gap` or more."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col(key).alias("key"), F.col("session_window.start").alias("bgn"), F.col("session_window.end").alias("end"), "n")


def totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total): running totals, for output mode complete or update."""
    return events.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
