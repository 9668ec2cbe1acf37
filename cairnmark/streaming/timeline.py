"""Trips and duplicates of files that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visits(events: DataFrame, gap: str = "10 days", late: str = "30 days") -> DataFrame:
    """(user_id, place, start_time, end_time, n) of a stream (user_id, place, ts): sessions that end after ``gap`` without an event; events later than ``late`` are dropped."""
    of = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", "place", of.alias("w")).agg(F.count("*").alias("n")).select("user_id", "place", F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n")


def arrivals(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(place, day, n, total): arrivals in tumbling windows of a stream (place, ts, value)."""
    return events.withWatermark("ts", late).groupBy("place", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("place", F.col("w.start").alias("day"), "n", "total")


def first_seen(files: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows of a stream (hash_value, ts, ...) whose hash was not seen within ``late``."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash_value"])


def unprocessed(files: DataFrame, done: DataFrame, cursor: str | None = None) -> DataFrame:
    """Files after ``cursor`` in order of path that ``done`` lacks, so that a run can be taken up again."""
    left = files if cursor is None else files.where(F.col("path") > cursor)
    return left.join(done.select("path"), "path", "left_anti")
