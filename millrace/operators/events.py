"""Roll-ups of events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Per window and type: n, total value in thousandths (whole numbers add up alike in any order), highest value."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type")
    milli = F.round(F.col("value") * 1000).cast("long")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(milli).alias("milli"), F.max("value").alias("highest")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "milli", "highest"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Per user and session (no pause of ``gap`` or more): start, events, types."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "types")
