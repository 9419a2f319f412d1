"""Structured Streaming forms: the same plan serves a stream and a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_time(rows: DataFrame, lateness: str) -> DataFrame:
    """A stream with its watermark, on ts as a point in time; a table as it is."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events and summed value by window and type; as a stream, rows later than lateness are dropped by the watermark."""
    rows = on_time(events, lateness)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of users: start, end and events, ended by a gap."""
    rows = on_time(events, lateness)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(rows: DataFrame, key: str, lateness: str = "2 hours") -> DataFrame:
    """Rows whose key was not seen within the watermark: the admission of new texts to a gallery."""
    return on_time(rows, lateness).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there into a memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
