"""Streams: repeated keys, weekly activity, late evidence and landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files that land in a folder, as a stream; each is read once."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def once_per_key(stream: DataFrame, key: str, at: str, delay: str = "2 minutes") -> DataFrame:
    """Drops rows that repeat a key within ``delay``; state older than that is forgotten."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def weekly_activity(stream: DataFrame, at: str, kind: str, delay: str = "1 day") -> DataFrame:
    """Counts by week from Monday and kind; the epoch's Thursday is shifted to Monday."""
    rows = stream.withWatermark(at, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, "7 days", "7 days", "4 days").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week_start"), kind, "n")


def windowed_sums(stream: DataFrame, at: str, key: str, value: str, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(at, delay) if stream.isStreaming else stream
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def affected_keys(late: DataFrame, key: str) -> DataFrame:
    """Entities that late evidence may reclassify; the rest keep their class."""
    return late.select(key).distinct()


def run_in_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that has landed, batch by batch, then stop; a schedule starts it again."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
