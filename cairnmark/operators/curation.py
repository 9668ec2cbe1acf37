"""Upkeep of lists, snapshots, destinations and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct values of ``key``, those of ``old`` before those of ``new``, each where it came first; (key, source, order)."""
    both = old.select(key, F.lit(0).alias("source"), order).unionByName(new.select(key, F.lit(1).alias("source"), order))
    return both.groupBy(key).agg(F.min(F.struct("source", order)).alias("first")).select(key, "first.*")


def last_line(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Of rows with one ``key`` the one of the last ``line``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), line).alias("row")).select(key, "row.*")


def differences(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change) of keys whose value was added, removed or changed."""
    b, a = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b")), after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(a, key, "full_outer").select(key, "before", "after", change.alias("change")).where("change IS NOT NULL")


def prefixes(path: Column) -> Column:
    """All folders above ``path``, each once, without a slash at the end."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def newest_under_root(files: DataFrame, roots: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, run_id): the newest run of a file's topics ``groups`` (file_id, run_id); without any, for files of this machine, the newest run (root, run_id) whose root is a folder above the file.

    Paths that are neither of the drive nor of this machine have none. Folders meet roots on equality.
    """
    known = files.where(F.col("path").startswith("local:") | F.col("path").startswith("disk:"))
    told = groups.groupBy(F.col("file_id").alias("id")).agg(F.max("run_id").alias("run_id")).where("run_id IS NOT NULL")
    first = known.select("id").join(told, "id")
    rest = known.where(F.col("path").startswith("local:")).join(told, "id", "left_anti")
    above = rest.select("id", F.explode(prefixes(F.col("path"))).alias("root"))
    return first.unionByName(above.join(roots, "root").groupBy("id").agg(F.max("run_id").alias("run_id")))


def merged(members: DataFrame, moves: DataFrame) -> DataFrame:
    """``members`` (id, cluster_id) after the clusters of ``moves`` (source, target) were emptied into their targets."""
    return members.join(moves.select(F.col("source").alias("cluster_id"), "target"), "cluster_id", "left").select("id", F.coalesce("target", "cluster_id").alias("cluster_id"))


def exclusive_labels(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Manual labels after ``chosen`` (file_id, choice) is written: a choice clears the other ones of its file."""
    joined = labels.join(chosen, "file_id", "left")
    now = lambda name, column: F.when(F.col("choice").isNull(), F.col(column)).otherwise((F.col("choice") == name).cast("int"))
    face = F.when(F.col("choice").isNull(), F.col("faces_label")).when(F.col("choice").isin("faces", "no_faces"), F.col("choice"))
    return joined.select("file_id", face.alias("faces_label"), now("people_no_face", "people_no_face").alias("people_no_face"), now("animals", "animals").alias("animals"), now("quarantine", "quarantine").alias("quarantine"))


def percent(done: Column, total: Column) -> Column:
    """Whole per cent, 0 to 100; null without a total."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 * done / total).cast("int"))))


def save_snapshot(faces: DataFrame, path: str) -> None:
    """Writes the faces of persons (person_id, face_id, cluster_id) as JSON lines in order of person and face."""
    faces.select("person_id", "face_id", "cluster_id").orderBy("person_id", "face_id").write.mode("overwrite").json(path)


def read_snapshot(spark, path: str) -> DataFrame:
    return spark.read.schema("person_id long, face_id long, cluster_id long").json(path)


def restored(labels: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``labels`` (person_id, face_id, cluster_id, source, confidence) with those of ``snapshot`` that are gone: same face, person and cluster."""
    keys = ["person_id", "face_id", "cluster_id"]
    same = labels.select(*(F.col(k).alias(f"_{k}") for k in keys))
    gone = snapshot.select(*keys).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & gone[k].eqNullSafe(same[f"_{k}"])
    back = gone.join(same, match, "left_anti").select(*keys, F.lit("restored_from_snapshot").alias("source"), F.lit(0.9).alias("confidence"))
    return labels.select(*keys, "source", "confidence").unionByName(back)
