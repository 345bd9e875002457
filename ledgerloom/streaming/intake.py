"""Optional streaming intake; the batch functions do the work, each batch once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_once(source: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch to its own folder; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_occurrences(source: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(source: DataFrame, time: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows in tumbling or sliding windows, final once the watermark has passed."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return source.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(source: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Runs of rows of a key with less than the gap between them; on a batch or a stream."""
    timed = source.withWatermark(time, late) if late else source
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
