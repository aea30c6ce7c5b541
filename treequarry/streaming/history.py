"""Action logs and objects as streams. The engine recomputes from tables; these keep the same results up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treequarry.operators import store

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, a few files at a time; ts as a timestamp for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tallies(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, command, n, total per window; events later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("event_type").alias("command"), "n", "total")


def keep_objects(contents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream with a column content, written to the store as far as it is new; runs until what is there is done."""

    def batch(rows: DataFrame, _: int) -> None:
        store.append_objects(rows.select("content"), path)

    return contents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
