"""Content rules that send files to target folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.naming import free_names


def group_counts(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """(file_id, group_name, n, names): distinct persons of each group on a file, and distinct names that count for the group.

    A name counts once on a file, in the group of the lowest person on it with that name.
    """
    own = persons.select(F.col("id").alias("person_id"), F.trim("group_name").alias("group_name"), F.nullif(F.trim("name"), F.lit("")).alias("name"))
    on_file = pairs.select("file_id", "person_id").distinct().join(own, "person_id")
    counts = on_file.groupBy("file_id", "group_name").agg(F.count("*").alias("n"))
    names = on_file.where("name IS NOT NULL").groupBy("file_id", "name").agg(F.min_by("group_name", "person_id").alias("group_name")).groupBy("file_id", "group_name").agg(F.count("*").alias("names"))
    return counts.join(names, ["file_id", "group_name"], "left").select("file_id", "group_name", "n", F.coalesce("names", F.lit(0)).alias("names"))


def rule_matches(pairs: DataFrame, persons: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_id, folder_id, sort_order) of the folders whose group rule a file meets: only one person, several names or any person of the group."""
    met = (F.col("kind") == "only_one") & (F.col("n") == 1) | (F.col("kind") == "multiple") & (F.col("names") >= 2) | (F.col("kind") == "contains")
    return group_counts(pairs, persons).join(folders, "group_name").where(met).select("file_id", F.col("id").alias("folder_id"), "sort_order")


def person_folders(pairs: DataFrame, persons: DataFrame, folders: DataFrame) -> DataFrame:
    """(file_id, name) of the first folder whose group rule a file meets."""
    w = Window.partitionBy("file_id").orderBy(F.col("sort_order").asc_nulls_last(), "folder_id")
    first = rule_matches(pairs, persons, folders).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_id", "folder_id")
    return first.join(folders.select(F.col("id").alias("folder_id"), "name"), "folder_id").select("file_id", "name")


def _fixed(folders: DataFrame) -> dict[str, str]:
    return {r.kind: r.name for r in folders.where("kind IN ('any', 'any_people')").collect()}  # rules are a small parameter table


def target_folder(rows: DataFrame, pairs: DataFrame, persons: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, target) of rows (id, tab): the first matching folder of files of faces, else the any-people folder; the animals folder; none for quarantine; else the tab."""
    named, fixed = person_folders(pairs, persons, folders), _fixed(folders)
    bound = pairs.select("file_id").distinct().withColumn("bound", F.lit(True))
    joined = rows.join(named, rows["id"] == named["file_id"], "left").drop("file_id").join(bound, F.col("id") == bound["file_id"], "left").drop("file_id")
    target = (
        F.when(F.col("tab") == "faces", F.coalesce("name", F.when(F.col("bound"), F.lit(fixed.get("any_people"))), F.lit("_faces")))
        .when(F.col("tab") == "animals", F.lit(fixed.get("any"))).when(F.col("tab") == "quarantine", F.lit(None)).otherwise(F.concat(F.lit("_"), "tab"))
    )
    return joined.select("id", target.alias("target"))


#: Folders of files set aside before sorting, of people without a face, of faces without a rule, and the names of the trip folder.
SET_ASIDE = {"non_media": "_non_media", "broken_media": "_broken_media"}
PEOPLE_NO_FACE, OTHER_PEOPLE, ANIMALS, TRIPS = "_people_no_face", "Другие люди", "_animals", ("Путешествия", "Поездки")


def _below(root: Column, rest: Column) -> Column:
    """``rest`` under a root of the drive, of this machine, or without a mark (of this machine)."""
    base = F.when(root.startswith("local:"), F.substr(root, F.lit(7))).otherwise(root)
    own = F.concat(F.lit("local:"), base, F.when((base == "") | base.endswith("/"), "").otherwise("/"), rest)
    return F.when(root.startswith("disk:"), F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), rest)).otherwise(own)


def _filled(path: Column) -> Column:
    """The parts of a path that are not blank, joined again; null without any."""
    return F.nullif(F.array_join(F.filter(F.split(path, "/"), lambda p: F.trim(p) != ""), "/"), F.lit(""))


def topic_path(group: Column, root: Column) -> Column:
    """The folder of a file without faces, by its topic: trips (a trip folder, one below it, or a name that begins with a year) under the root's trip folder, other topics on this machine; none without a topic.

    The prefix of a folder below a trip folder is taken with the character after its slash, as it always has been.
    """
    topic = F.trim(F.coalesce(group, F.lit("")))
    topic = F.when(topic.startswith("_no_faces/"), F.trim(F.substr(topic, F.lit(11)))).otherwise(topic)
    trips = F.lit(TRIPS[0])
    trip = F.when(topic.isin(*TRIPS), trips)
    for name in TRIPS:
        trip = F.coalesce(trip, F.when(topic.startswith(f"{name}/"), F.concat_ws("/", trips, _filled(F.substr(topic, F.lit(len(name) + 3))))))
    trip = F.coalesce(trip, F.when(topic.rlike(r"^[0-9]{4}\s"), F.concat_ws("/", trips, topic)))
    base = F.when(root.startswith("disk:"), F.regexp_replace(root, "/+$", "")).otherwise(root)
    return F.when(topic == "", None).when(trip.isNotNull(), _below(root, trip)).otherwise(_below(F.when(root.startswith("disk:"), F.concat(F.lit("local:"), base)).otherwise(base), _filled(topic)))


def target_path(rows: DataFrame, pairs: DataFrame, persons: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, target) of rows (id, tab, set_aside, group_path, root): where the file belongs under the root of its run, null where it stays.

    What was set aside before sorting goes to its own folder, if its kind has one. Faces go to the first folder whose rule they
    meet, else to the one for any people; quarantine stays; a folder with a path on the drive (folders may have ``path``) keeps
    it where the root is on the drive.
    """
    fixed = _fixed(folders)
    named = person_folders(pairs, persons, folders).withColumnRenamed("file_id", "id").withColumnRenamed("name", "own")
    tab = F.col("tab")
    name = (
        F.when(tab == "faces", F.coalesce(F.nullif(F.trim("own"), F.lit("")), F.lit(fixed.get("any_people") or OTHER_PEOPLE)))
        .when(tab == "animals", F.lit(fixed.get("any") or ANIMALS))
    )
    service = F.when(tab == "people_no_face", PEOPLE_NO_FACE)
    for kind, folder in SET_ASIDE.items():
        service = F.when(F.col("set_aside") == kind, folder).otherwise(service)
    aside = F.coalesce(F.col("set_aside"), F.lit("")) != ""
    known = folders.select(F.col("name").alias("name"), (F.col("path") if "path" in folders.columns else F.lit(None).cast("string")).alias("there")).where("there LIKE 'disk:%'").groupBy("name").agg(F.min("there").alias("there"))
    told = rows.join(named, "id", "left").withColumn("name", F.when(~aside, name)).withColumn("service", F.when(~aside | F.col("set_aside").isin(*SET_ASIDE), service)).join(known, "name", "left")
    root = F.col("root")
    drive = F.when(root.startswith("disk:"), F.col("there"))
    target = F.when(F.col("service").isNotNull(), _below(root, F.col("service"))).when(F.col("name").isNotNull(), F.coalesce(drive, _below(root, F.col("name")))).when(~aside & (tab == "no_faces"), topic_path(F.col("group_path"), root))
    return told.select("id", target.alias("target"))


def routing_report(targets: DataFrame) -> DataFrame:
    """(bucket, n): files by target; none, and those named after a tab, are unsorted."""
    bucket = F.when(F.col("target").isNull() | F.col("target").startswith("_"), "unsorted").otherwise(F.col("target"))
    return targets.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def move_plan(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, src, dst): each file with a target there, in the order of their paths, under the first free name; files that are at a target and have none themselves keep their names occupied."""
    name, parent = F.substring_index("path", "/", -1), F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    moved = targets.where("target IS NOT NULL")
    planned = files.join(moved, "id").select("id", F.col("path").alias("src"), F.col("target").alias("folder"), name.alias("name"))
    there = files.join(moved, "id", "left_anti").select(parent.alias("folder"), name.alias("name"))
    return free_names(planned, there, ["src", "id"]).select("id", "src", F.concat("folder", F.lit("/"), "unique_name").alias("dst"))
