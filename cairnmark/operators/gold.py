"""Agreement with gold labels, and hygiene of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_tab(gold: DataFrame) -> DataFrame:
    """(path, expected): of several gold lists the first in order of priority."""
    return gold.groupBy("path").agg(F.min(F.struct("priority", "expected")).alias("g")).select("path", F.col("g.expected").alias("expected"))


def misses(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """(expected, total, wrong) of files (path, tab) that gold lists."""
    return rows.join(expected_tab(gold), "path").groupBy("expected").agg(F.count("*").alias("total"), F.count_if(F.col("tab") != F.col("expected")).alias("wrong"))


def in_several_lists(gold: DataFrame) -> DataFrame:
    return gold.groupBy("path").agg(F.countDistinct("expected").alias("n")).where("n > 1")


def band_matches(wanted: DataFrame, found: DataFrame, band: int) -> DataFrame:
    """(id, match_id): for each wanted box the found one of the same file with every coordinate within ``band``: assigned first, then nearest, then lowest id."""
    sides = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")
    f = found.select("file_id", F.col("id").alias("match_id"), "cluster_id", *[F.col(c).alias(f"f_{c}") for c in sides])
    near = [F.abs(F.col(c) - F.col(f"f_{c}")) for c in sides]
    total = near[0] + near[1] + near[2] + near[3]
    inside = (near[0] <= band) & (near[1] <= band) & (near[2] <= band) & (near[3] <= band)
    w = Window.partitionBy("id").orderBy(F.col("cluster_id").isNull(), total, "match_id")
    return wanted.select("id", "file_id", *sides).join(f, "file_id").where(inside).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "match_id")


def binding_buckets(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(bucket, n_files): files with no, one or several persons."""
    n = pairs.groupBy("file_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n").isNull(), "0").when(F.col("n") == 1, "1").otherwise("2+")
    return files.join(n, files["id"] == n["file_id"], "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_files"))


def superfluous_boxes(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of detections of one box that another one of it makes superfluous: manual ones are kept first, then clustered ones, then the lowest id."""
    w = Window.partitionBy(*keys).orderBy(F.col("manual_person_id").isNull(), F.col("cluster_id").isNull(), "id")
    return rects.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("id")


def completeness(files: DataFrame, columns: list[str]) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return files.agg(F.count("*").alias("n"), *[filled(c).alias(f"with_{c}") for c in columns])


def recall(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    return rows.agg(F.count_if(truth).alias("positives"), F.count_if(truth & said).alias("found"), F.count_if(~truth & said).alias("false"))
