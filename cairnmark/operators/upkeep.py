"""Clusters that are kept up to date, automatic decisions about files, and names for people to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The root folder of the photo archive.
ARCHIVE_ROOT = "Фото"


def persisted(labels: DataFrame, clusters: DataFrame, first: int) -> DataFrame:
    """(id, cluster_id): detections (id, label) in new clusters numbered from ``first``; noise (-1) has none.

    Detections of ``clusters`` (id, cluster_id, person_id, method) whose cluster has a person or was made by hand keep it.
    """
    owned = clusters.where("person_id IS NOT NULL OR method = 'manual'").select("id", F.col("cluster_id").alias("owned"))
    new = F.when(F.col("label") >= 0, F.lit(first) + F.col("label"))
    return labels.join(owned, "id", "left").select("id", F.coalesce("owned", new).cast("long").alias("cluster_id"))


def merged(clusters: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, person_id) of the clusters that stay after ``moves`` (source, target): emptied sources are dropped, a target without a person inherits its sources' lowest."""
    heirs = moves.join(clusters.withColumnRenamed("id", "source"), "source").groupBy("target").agg(F.min("person_id").alias("heir"))
    stay = clusters.join(moves.withColumnRenamed("source", "id"), "id", "left_anti")
    return stay.join(heirs, stay["id"] == heirs["target"], "left").select("id", F.coalesce("person_id", "heir").alias("person_id"))


def edited(members: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, cluster_id) after ``edits`` (id, action, cluster_id): move sets the cluster, remove and clear leave none."""
    e = edits.select("id", "action", F.col("cluster_id").alias("to"))
    then = F.when(F.col("action") == "move", F.col("to")).when(F.col("action").isin("remove", "clear"), F.lit(None)).otherwise(F.col("cluster_id"))
    return members.join(e, "id", "left").select("id", then.cast("long").alias("cluster_id"))


def farthest(distances: DataFrame, top: int) -> DataFrame:
    """The ``top`` members of each cluster farthest from its centroid; equals by id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("distance"), "id")
    return distances.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def tiny_faces(boxes: DataFrame, sizes: DataFrame, side: int = 32, share: float = 0.0012) -> DataFrame:
    """(file_id, reason): files whose largest face side is at most ``side`` pixels and largest face covers at most ``share`` of the frame (no frame size: none of it)."""
    most = boxes.groupBy("file_id").agg(F.max(F.greatest("bbox_w", "bbox_h")).alias("side"), F.max(F.col("bbox_w") * F.col("bbox_h")).alias("area"))
    covered = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("area") / (F.col("width") * F.col("height"))).otherwise(0.0)
    return most.join(sizes, "file_id", "left").where((F.col("side") <= side) & (covered <= share)).select("file_id", F.lit("tiny_face").alias("reason"))


def faces_after_cats(most: int = 2) -> Column:
    """Faces that count: none where at most ``most`` were found and the detector saw a cat and no person."""
    return F.when((F.col("faces_count") <= most) & F.col("has_cat") & ~F.col("has_person"), 0).otherwise(F.col("faces_count"))


def searched(files: DataFrame, wanted: str, columns: list[str], page: int, size: int) -> DataFrame:
    """A page (from 1) of the rows in which one of two columns holds ``wanted`` in any case, newest id first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False))
    return files.where(hit).orderBy(F.desc("id")).offset(size * (page - 1)).limit(size)


def folder_name(path: Column, root: str = ARCHIVE_ROOT) -> Column:
    """The folder below the archive's root, else the one that holds the file; null without any."""
    parts = F.split(F.regexp_replace(path, "(disk|local):/", ""), "/")
    return F.when(F.size(parts) >= 2, F.when(parts[0] == root, parts[1]).otherwise(F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(1))))


def short_folder(path: Column) -> Column:
    """The third part of a path of the drive, or a dash."""
    part = F.try_element_at(F.split(path, "/"), F.lit(3))
    return F.when(path.startswith("disk:/") & (F.coalesce(part, F.lit("")) != ""), part).otherwise("—")


def short_path(path: Column, root: str = ARCHIVE_ROOT) -> Column:
    """What follows the archive's root, after an ellipsis; other paths as they are."""
    prefix = f"disk:/{root}/"
    return F.when(path.startswith(prefix), F.concat(F.lit("…/"), F.substr(path, F.lit(len(prefix) + 1)))).otherwise(F.coalesce(path, F.lit("")))
