"""Effective categories of files: automatic signals, human labels and person bindings, by priority.

The five variants differ on purpose and are never unified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTSIDER = 6
MANY = 8


def person_of(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    """Detections that are not ignored, with their effective person: the manual one, else the cluster's."""
    c = clusters.select(F.col("id").alias("cluster_id"), "person_id")
    return rects.where("ignore_flag = 0").join(c, "cluster_id", "left").withColumn("person", F.coalesce("manual_person_id", "person_id")).drop("person_id")


def bindings(rects: DataFrame, clusters: DataFrame, file_persons: DataFrame) -> DataFrame:
    """Distinct (file_id, person_id) over all routes, without the outsider."""
    faces = person_of(rects, clusters).where("person IS NOT NULL").select("file_id", F.col("person").alias("person_id"))
    return faces.union(file_persons.select("file_id", "person_id")).where(F.col("person_id") != OUTSIDER).distinct()


def labels_of_run(labels: DataFrame, run: int) -> DataFrame:
    """The manual labels (run, file_id, ...) that were set in one run."""
    return labels.where(F.col("run") == run).drop("run")


def labelled(files: DataFrame, labels: DataFrame, bound: DataFrame) -> DataFrame:
    """Files not deleted with their manual labels and whether a person is bound."""
    m = labels.withColumnRenamed("file_id", "id")
    b = bound.select(F.col("file_id").alias("id"), F.lit(True).alias("bound")).distinct()
    return files.where(F.coalesce("status", F.lit("")) != "deleted").join(m, "id", "left").join(b, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))


def _is(name: str) -> Column:
    return F.coalesce(name, F.lit(0)) == 1


def _by_count() -> Column:
    return F.when(F.col("faces_count") > 0, "faces").otherwise("no_faces")


def _auto(exempt: bool = True) -> Column:
    quarantined = (F.col("auto_quarantine") == 1) & (F.col("faces_count") > 0)
    return quarantined & (F.col("quarantine_reason") != "many_small_faces") if exempt else quarantined


def tab_metrics() -> Column:
    return F.when(_is("people_no_face"), "people_no_face").when(F.col("faces_label").isNotNull(), F.col("faces_label")).when(_is("quarantine") & (F.col("faces_count") > 0), "quarantine").when(_is("animals") | _is("animals_auto"), "animals").when(_auto(), "quarantine").otherwise(_by_count())


def tab_ui() -> Column:
    return (
        F.when(_is("people_no_face") | F.col("faces_label").eqNullSafe("faces") | F.col("bound"), "faces").when(F.col("faces_label").eqNullSafe("no_faces") | _is("quarantine"), "no_faces")
        .when(_is("animals") | _is("animals_auto"), "animals").when(_auto(), "no_faces").otherwise(_by_count())
    )


def tab_routing() -> Column:
    plain = F.when(_is("people_no_face"), "people_no_face").when(F.col("faces_label").isNotNull(), F.col("faces_label")).when(_is("quarantine") & (F.col("faces_count") > 0), "quarantine").when(_is("animals") | _is("animals_auto"), "animals").when(_auto(False), "quarantine").otherwise(_by_count())
    return F.when(F.col("bound") & plain.isin("no_faces", "people_no_face", "quarantine"), "faces").otherwise(plain)


def code_split() -> Column:
    face = F.when(F.col("faces_label") == "faces", 2).when(F.col("faces_label") == "no_faces", 0)
    plain = F.when(_is("people_no_face"), 4).when((F.col("faces_count") == 0) & (_is("animals") | _is("animals_auto")), 3).when(F.col("faces_count") > 0, 2).otherwise(0)
    return F.coalesce(face, F.when(_auto(False), 1), plain)


def tab_auto() -> Column:
    return F.when(_is("animals_auto"), "animals").when(_auto(), "quarantine").otherwise(_by_count())


def tab_counts(rows: DataFrame) -> DataFrame:
    """Files by tab and of special groups, in one pass."""
    tab = rows.withColumn("tab", tab_ui())
    unsorted = ~F.col("bound") & F.col("faces_label").isNull()
    counted = {"faces": F.col("tab") == "faces", "no_faces": F.col("tab") == "no_faces", "animals": F.col("tab") == "animals", "many_faces": F.col("faces_count") >= MANY, "unsorted": unsorted, "unsorted_photos": unsorted & (F.col("media_type") == "image"), "unsorted_videos": unsorted & (F.col("media_type") == "video")}
    return tab.agg(*[F.count_if(c).alias(k) for k, c in counted.items()])


def outsider_files(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    """Files with the outsider or an unassigned face and no other person."""
    p = person_of(rects, clusters)
    return p.groupBy("file_id").agg(F.max((F.col("person").isNotNull() & (F.col("person") != OUTSIDER)).cast("int")).alias("other"), F.max((F.col("person").isNull() | (F.col("person") == OUTSIDER)).cast("int")).alias("outside")).where("other = 0 AND outside = 1").select("file_id")


def merge_labels(kept: DataFrame, moved: DataFrame) -> DataFrame:
    """Labels (file_id, faces_label, animals) of files that take over others': a label that is not empty wins, flags are joined."""
    m = moved.select("file_id", F.col("faces_label").alias("new_label"), F.col("animals").alias("new_animals"))
    return kept.join(m, "file_id", "full_outer").select("file_id", F.coalesce(F.expr("nullif(trim(new_label), '')"), "faces_label").alias("faces_label"), F.greatest(F.coalesce("animals", F.lit(0)), F.coalesce("new_animals", F.lit(0))).alias("animals"))
