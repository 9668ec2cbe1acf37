"""Trips: sessions of a timeline by place and date, and files by date range."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.ordering import places
from cairnmark.operators.shared import kept


def sessions(timeline: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """``timeline`` with ``trip``, numbered in each key: a gap of more than ``gap`` days begins a new one. A null day neither begins one nor lets the next do so."""
    w = Window.partitionBy(*keys).orderBy(F.col("day").asc_nulls_first(), "event_id")
    new = F.when(F.datediff("day", F.lag("day").over(w)) > gap, 1).otherwise(0)
    return timeline.withColumn("_new", new).withColumn("trip", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def dated(files: DataFrame) -> DataFrame:
    return files.withColumn("day", F.expr("try_cast(substring(taken_at, 1, 10) AS date)"))


def in_range(files: DataFrame, trips: DataFrame, pad: int = 0) -> DataFrame:
    """(trip_id, file_id) of files dated within ``pad`` days of a trip. The trips' days are listed, so files meet them on equal days."""
    days = trips.where("start_date IS NOT NULL AND end_date IS NOT NULL").select(F.col("id").alias("trip_id"), F.explode(F.sequence(F.date_sub("start_date", pad), F.date_add("end_date", pad))).alias("day"))
    return dated(files).join(days, "day").select("trip_id", F.col("id").alias("file_id"))


def suggestions(files: DataFrame, trips: DataFrame, trip_files: DataFrame) -> DataFrame:
    """Files dated within a day of a trip that no trip includes."""
    taken = trip_files.where("status = 'included'").select("file_id")
    return in_range(files, trips, 1).join(taken, "file_id", "left_anti").select("trip_id", "file_id")


def _before(days: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(x, trip_id, at): for each of ``days`` (x) the ``limit`` edges (at, trip_id) with the largest ``at`` below it; of equals the lowest ids.

    Days and edges lie in ranges of one order. A scan of a range keeps ``limit`` edges; it begins with the last ones of the
    ranges before, of which the driver sees ``limit`` for each range.
    """
    of_day = Window.partitionBy("at").orderBy("trip_id")
    few = edges.withColumn("_n", F.row_number().over(of_day)).where(F.col("_n") <= limit)
    both = days.select("x", F.lit(None).cast("long").alias("trip_id")).unionByName(few.select(F.col("at").alias("x"), "trip_id"))
    order = ["x", F.col("trip_id").asc_nulls_first()]
    spread = kept(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    last = Window.partitionBy("part").orderBy(F.desc("x"), "trip_id")
    tails = spread.where("trip_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit).collect()
    begun: dict[int, list] = {}
    for part in {r.part for r in spread.select("part").distinct().collect()}:
        begun[part] = sorted(((-r.x, r.trip_id) for r in tails if r.part < part))[:limit]

    def scan(frames):
        part, held, here, at = None, [], [], None
        for pdf in frames:
            out = []
            for p, x, trip in zip(pdf["part"].tolist(), pdf["x"].tolist(), pdf["trip_id"].tolist(), strict=True):
                if p != part:
                    part, held, here, at = p, begun[p], [], None
                if x != at:
                    held, here, at = (here + held)[:limit], [], x
                if trip == trip and trip is not None:
                    here.append((-x, int(trip)))
                else:
                    out += [(x, t, -y) for y, t in held]
            yield pd.DataFrame(out, columns=["x", "trip_id", "at"], dtype="int64")

    return spread.repartition("part").sortWithinPartitions("part", *order).mapInPandas(scan, "x long, trip_id long, at long")


def nearest_trips(days: DataFrame, trips: DataFrame, limit: int) -> DataFrame:
    """(day, trip_id, rank, seconds) of the ``limit`` trips next to each day; 0 seconds inside. A trip without an end, or that ends before it starts, lasts a day.

    Candidates are the lowest trips over the day (met on equal days) and the nearest on either side.
    """
    start = F.unix_date("start_date").cast("long")
    t = trips.where("start_date IS NOT NULL").select(F.col("id").cast("long").alias("trip_id"), start.alias("a"), F.greatest(start, F.coalesce(F.unix_date("end_date").cast("long"), start)).alias("b"))
    days = days.where("day IS NOT NULL").select(F.unix_date("day").cast("long").alias("x")).distinct()
    over = t.select("trip_id", F.explode(F.sequence("a", "b")).alias("x")).join(days, "x", "left_semi")
    lowest = Window.partitionBy("x").orderBy("trip_id")
    inside = over.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= limit).select("x", "trip_id", F.col("x").alias("at"))
    ended = _before(days, t.select("trip_id", F.col("b").alias("at")), limit)
    begins = _before(days.select((-F.col("x")).alias("x")), t.select("trip_id", (-F.col("a")).alias("at")), limit).select((-F.col("x")).alias("x"), "trip_id", (-F.col("at")).alias("at"))
    scored = inside.unionByName(ended).unionByName(begins).select(F.date_from_unix_date(F.col("x").cast("int")).alias("day"), "trip_id", (F.abs(F.col("x") - F.col("at")) * 86400).alias("seconds"))
    w = Window.partitionBy("day").orderBy("seconds", "trip_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def date_ranges(files: DataFrame, trip_files: DataFrame) -> DataFrame:
    """(trip_id, first_day, last_day, n_files) of included files."""
    own = dated(files).select(F.col("id").alias("file_id"), "day")
    return trip_files.where("status = 'included'").join(own, "file_id").groupBy("trip_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_files"))


def listed(trips: DataFrame) -> DataFrame:
    """Trips with their position: leading year descending, start descending (nulls last), name without case, id descending."""
    year = F.expr("try_cast(nullif(regexp_extract(trim(name), '^([0-9]{4})', 1), '') AS int)")
    order = [F.desc_nulls_last("year"), F.desc_nulls_last("start_date"), F.lower("name"), F.desc("id")]
    return places(trips.withColumn("year", year), [], order).select("id", "year", (F.col("place") + 1).alias("position"))


def by_date(files: DataFrame, trip_files: DataFrame) -> DataFrame:
    own = dated(files).select(F.col("id").alias("file_id"), F.coalesce(F.col("day").cast("string"), F.lit("_no_date")).alias("bucket"))
    return trip_files.where("status = 'included'").join(own, "file_id").groupBy("trip_id", "bucket").agg(F.count("*").alias("n"))


def imported(trips: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """``trips`` (id, name, start_date, end_date, place_country) after the import of ``rows`` (line, name, place_country, start_date, end_date).

    Of rows of one name the last line counts. A trip of that name (white space around it aside) takes its dates and country;
    without one it is a new trip with a null id, but only if a file was taken on a day of one of the rows of that name.
    """
    days = dated(files).where("day IS NOT NULL").select("day").distinct()
    named = rows.withColumn("name", F.trim("name"))
    within = named.select("name", F.explode(F.sequence("start_date", "end_date")).alias("day")).join(days, "day", "left_semi").select("name").distinct()
    last = named.groupBy("name").agg(F.max_by(F.struct("place_country", "start_date", "end_date"), "line").alias("now"))
    known = trips.withColumn("key", F.trim("name"))
    kept_trips = known.join(last.withColumnRenamed("name", "key"), "key", "left").select("id", "name", *(F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in ("start_date", "end_date", "place_country")))
    new = last.join(known.select(F.col("key").alias("name")), "name", "left_anti").join(within, "name", "left_semi")
    return kept_trips.unionByName(new.select(F.lit(None).cast(trips.schema["id"].dataType).alias("id"), "name", "now.start_date", "now.end_date", "now.place_country"))
