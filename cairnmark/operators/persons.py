"""Persons, clusters and topic groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.labels import OUTSIDER, bindings, outsider_files, person_of


def persons_with_files(persons: DataFrame, rects: DataFrame, clusters: DataFrame, file_persons: DataFrame) -> DataFrame:
    """(person_id, name, n_files): distinct files of each person over all routes; the outsider by its own rule."""
    pairs = bindings(rects, clusters, file_persons)
    counted = pairs.groupBy("person_id").agg(F.count("*").alias("n_files"))
    outside = outsider_files(rects, clusters).agg(F.count("*").alias("n_files")).select(F.lit(OUTSIDER).cast("long").alias("person_id"), "n_files")
    return counted.unionByName(outside).join(persons.select(F.col("id").alias("person_id"), "name"), "person_id").where("n_files > 0")


def person_stats(persons: DataFrame, rects: DataFrame, clusters: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters, faces and files of each person, files split by scope."""
    faces = person_of(rects, clusters).where("person IS NOT NULL").join(files.select(F.col("id").alias("file_id"), "inventory_scope"), "file_id", "left")
    by = faces.groupBy("person").agg(
        F.count_if(F.col("cluster_id").isNotNull()).alias("via_clusters"), F.count_if(F.col("cluster_id").isNull()).alias("via_manual"),
        F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct(F.when(F.col("inventory_scope") == "archive", F.col("file_id"))).alias("archive_files"), F.countDistinct(F.when(F.col("inventory_scope") == "source", F.col("file_id"))).alias("source_files"),
    )
    counts = ("via_clusters", "via_manual", "n_clusters", "archive_files", "source_files")
    return persons.join(by, persons["id"] == by["person"], "left").select("id", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def cluster_list(clusters: DataFrame, rects: DataFrame) -> DataFrame:
    """Clusters with their size and preview: the largest face, then the surest, then the lowest id."""
    faces = rects.where("ignore_flag = 0 AND cluster_id IS NOT NULL")
    best = F.max(F.struct((F.col("bbox_w") * F.col("bbox_h")).alias("area"), "confidence", (-F.col("id")).alias("neg")))
    sized = faces.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.countDistinct("file_id").alias("n_files"), (-best["neg"]).alias("preview_id"))
    return clusters.join(sized, clusters["id"] == sized["cluster_id"]).select("id", "person_id", "scope", "n_faces", "n_files", "preview_id")


def cluster_faces(rects: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` faces of each cluster by area, then confidence, then id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.col("bbox_w") * F.col("bbox_h")), F.desc("confidence"), "id")
    return rects.where("ignore_flag = 0 AND cluster_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("cluster_id", "id", "rank")


def distinct_boxes(rects: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """One detection of each box of a file, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rects.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def person_items(rects: DataFrame, clusters: DataFrame, file_persons: DataFrame) -> DataFrame:
    """(person_id, file_id, route) of every way in which a file belongs to a person."""
    c = clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), "person_id")
    seen = rects.where("ignore_flag = 0")
    return (
        seen.join(c, "cluster_id").select("person_id", "file_id", F.lit("cluster").alias("route"))
        .unionByName(seen.where("manual_person_id IS NOT NULL").select(F.col("manual_person_id").alias("person_id"), "file_id", F.lit("manual").alias("route")))
        .unionByName(file_persons.select("person_id", "file_id", F.lit("file").alias("route"))).distinct()
    )


def repeated_persons(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    """(file_id, person, n) of persons with more than one detection in a file, but the outsider."""
    p = person_of(rects, clusters).where(F.col("person").isNotNull() & (F.col("person") != OUTSIDER))
    return p.groupBy("file_id", "person").agg(F.count("*").alias("n")).where("n > 1")


def presence(rects: DataFrame) -> DataFrame:
    """(id, score): a detection's share of the area of all detections of its file."""
    area = F.col("bbox_w") * F.col("bbox_h")
    return rects.select("id", F.round(area / F.sum(area).over(Window.partitionBy("file_id")), 6).alias("score"))


def majority_person(rects: DataFrame, clusters: DataFrame, label: Column) -> DataFrame:
    """(cluster_id, person, n): the most frequent label of each cluster; of equals the lowest."""
    n = rects.where("cluster_id IS NOT NULL").groupBy("cluster_id", label.alias("person")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "person")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def one_person_folder(files: DataFrame, pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, folder): the name of the only person of a file, else _mixed or _unassigned."""
    n = pairs.groupBy("file_id").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).join(persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    folder = F.when(F.col("n").isNull(), "_unassigned").when(F.col("n") > 1, "_mixed").otherwise(F.col("name"))
    return files.select("id").join(n, F.col("id") == F.col("file_id"), "left").select("id", folder.alias("folder"))


def topic_groups(file_groups: DataFrame) -> DataFrame:
    return file_groups.groupBy("group_path").agg(F.countDistinct("file_id").alias("n_files"), F.max("created").alias("last_created"))
