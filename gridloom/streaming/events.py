"""Windows over event streams. Every function takes a static or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums for each window and key; rows later than ``late`` are left out of a stream."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def appended_cells(events: DataFrame) -> DataFrame:
    """A stream of records as cells: the row is the event's number, each field a column."""
    fields = ["event_id", "user_id", "event_type"]
    packed = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("token")) for i, c in enumerate(fields, 1)])
    return events.select((F.col("event_id") + 1).alias("row"), F.explode(packed).alias("c")).select("row", "c.col", "c.token").where("token is not null")
