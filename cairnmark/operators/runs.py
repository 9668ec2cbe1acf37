"""Runs over the catalogue: which files a run covers, what a crawl changes, folders as trips, content rules as text, snapshots of a run's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.operators.routing import group_counts

#: Heads of the content rules by kind, and the words of the older grammar.
RULE_HEADS = {"only_one": "only_one_from_group", "multiple": "multiple_from_group", "contains": "contains_group"}
OLD_RULES = ("только", "вместе", "содержит")


def _of_faces(face_run: int, root: str | None) -> Column:
    """Files of the face run, and with ``root`` also videos below it that no face run has seen. A root is a plain prefix, not a pattern."""
    own = F.col("faces_run_id").eqNullSafe(F.lit(face_run))
    if root is None:
        return own
    video = F.col("media_type").eqNullSafe("video") | F.coalesce(F.col("mime_type").startswith("video/"), F.lit(False))
    return own | F.col("faces_run_id").isNull() & video & F.col("path").startswith(root.rstrip("/") + "/")


def _of_source(dedup_run: int) -> Column:
    return F.col("inventory_scope").eqNullSafe("source") & F.col("last_run_id").eqNullSafe(F.lit(dedup_run))


def listed_in_run(face_run: int, root: str | None = None, dedup_run: int | None = None) -> Column:
    """Whether a run's list shows a file: of its faces, and of its source files if a duplicate run is named. Deleted files and those without a status are not shown."""
    shown = _of_faces(face_run, root)
    return F.coalesce(F.col("status") != "deleted", F.lit(False)) & (shown if dedup_run is None else shown & _of_source(dedup_run))


def counted_in_run(face_run: int, root: str | None = None, dedup_run: int | None = None) -> Column:
    """Whether a run's tab counts take a file: a duplicate run stands in place of the face run here."""
    taken = _of_faces(face_run, root) if dedup_run is None else _of_source(dedup_run)
    return F.coalesce(F.col("status") != "deleted", F.lit(False)) & taken


def _trip_folder() -> Column:
    return F.regexp_replace(F.trim("folder"), "/+$", "")


def new_trips(listing: DataFrame, trips: DataFrame) -> DataFrame:
    """(name, folder) of the folders of a listing (name, path, type) with a name that are no trip's folder yet."""
    own = trips.select(_trip_folder().alias("folder")).where("folder <> ''")
    there = listing.where("type = 'dir'").select(F.trim("name").alias("name"), F.regexp_replace("path", "/+$", "").alias("folder")).where("name <> '' AND folder <> ''")
    return there.distinct().join(own, "folder", "left_anti").select("name", "folder")


def new_trip_files(files: DataFrame, trips: DataFrame, trip_files: DataFrame) -> DataFrame:
    """(trip_id, file_id): files not deleted in the folder of a trip (id, folder) that are not linked with it; a space at the end of a folder in a file's path is overlooked.

    A file meets trips by the folders on its own path, so the join is by equality.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(above, F.transform(above, lambda p: F.regexp_replace(p, " $", "")), F.array("path")))
    live = files.where("status IS NULL OR status <> 'deleted'").select(F.col("id").alias("file_id"), F.explode(keys).alias("folder"))
    own = trips.select(F.col("id").alias("trip_id"), _trip_folder().alias("folder")).where("folder <> ''")
    return live.join(own, "folder").select("trip_id", "file_id").distinct().join(trip_files.select("trip_id", "file_id"), ["trip_id", "file_id"], "left_anti")


def _stripped(column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def parsed_rules(folders: DataFrame) -> DataFrame:
    """(id, kind, group_id, group_name, person_id) of the rules (id, rule) that are well formed.

    A rule is its parts between colons, trimmed. Alone, animals and any_people are rules. The first part, in any case, names a
    group's kind (``RULE_HEADS``), with ``_id`` if a number names the group. Only only_one may go on with a person's number;
    the name in the other kinds is all that follows. Other texts, empty and null ones give no row.
    """
    rule = _stripped(F.col("rule"))
    cells = F.transform(F.split(rule, ":"), lambda c: _stripped(c))
    head, second, third = (F.lower(F.get(cells, F.lit(0))), F.get(cells, F.lit(1)), F.get(cells, F.lit(2)))
    rest = _stripped(F.regexp_replace(rule, "^[^:]*:", ""))
    number = lambda c: c.rlike("^[0-9]+$")
    count = F.size(cells)
    kind, group, name, person = F.when(rule.isin("animals", "any_people"), rule), F.lit(None), F.lit(None), F.lit(None)
    for k, start in RULE_HEADS.items():
        one = k == "only_one"
        tail = (count == 2) | (count == 3) & number(third) if one else (count == 2)
        by_id = (head == f"{start}_id") & tail & number(second)
        by_name = (head == start) & (tail & (second != "") if one else (count >= 2) & (rest != ""))
        kind = F.coalesce(kind, F.when(by_id | by_name, k))
        group = F.coalesce(group, F.when(by_id, second))
        name = F.coalesce(name, F.when(by_name, second if one else rest))
        if one:
            person = F.when(by_id | by_name, third)
    read = folders.select("id", kind.alias("kind"), group.cast("long").alias("group_id"), name.cast("string").alias("group_name"), person.cast("long").alias("person_id"))
    return read.where("kind IS NOT NULL")


def old_rules(folders: DataFrame) -> DataFrame:
    """(id, position, kind, names) of the older grammar: parts between semicolons, each a kind (``OLD_RULES``, in any case), a colon and names between square brackets, parted by commas.

    Parts of other forms or without names are left out.
    """
    parts = folders.select("id", F.posexplode(F.split("rule", ";")).alias("position", "part"))
    kind, listed = F.lower(_stripped(F.substring_index("part", ":", 1))), _stripped(F.regexp_replace("part", "^[^:]*:", ""))
    fits = F.col("part").contains(":") & kind.isin(*OLD_RULES) & listed.startswith("[") & listed.endswith("]") & (F.length(listed) >= 2)
    names = F.filter(F.transform(F.split(F.substr(listed, F.lit(2), F.length(listed) - 2), ","), lambda n: F.trim(n)), lambda n: n != "")
    return parts.where(fits).select("id", "position", kind.alias("kind"), names.alias("names")).where(F.size("names") > 0)


def rule_files(pairs: DataFrame, persons: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, folder_id) of the files with persons ``pairs`` (file_id, person_id) that meet a parsed group rule; persons are (id, group_id, group_name, name).

    By group id, ``multiple`` counts persons; by group name it counts distinct names, each in the group of the lowest person of that name on the file.
    """
    on_file = pairs.select("file_id", "person_id").distinct().join(persons.select(F.col("id").alias("person_id"), "group_id"), "person_id")
    by_id = on_file.groupBy("file_id", "group_id").agg(F.count("*").alias("n"), F.count("*").alias("names"), F.max("person_id").alias("who"))
    named = pairs.select("file_id", "person_id").distinct().join(persons.select(F.col("id").alias("person_id"), F.trim("group_name").alias("group_name")), "person_id")
    by_name = group_counts(pairs, persons).join(named.groupBy("file_id", "group_name").agg(F.max("person_id").alias("who")), ["file_id", "group_name"])
    tests = rules.select(F.col("id").alias("folder_id"), "kind", "group_id", "group_name", F.col("person_id").alias("asked"))
    found = []
    for key, counts in (("group_id", by_id), ("group_name", by_name)):
        one = (F.col("kind") == "only_one") & (F.col("n") == 1) & (F.col("asked").isNull() | (F.col("asked") == F.col("who")))
        met = one | (F.col("kind") == "multiple") & (F.col("names") >= 2) | (F.col("kind") == "contains")
        found.append(counts.join(tests.where(F.col(key).isNotNull()).select("folder_id", "kind", "asked", key), key).where(met).select("file_id", "folder_id"))
    return found[0].unionByName(found[1])


def newest_runs(runs: DataFrame) -> DataFrame:
    """(face_run_id, pipeline_run_id): the latest run of each face run."""
    return runs.where("face_run_id IS NOT NULL").groupBy("face_run_id").agg(F.max("id").alias("pipeline_run_id"))


def run_figures(runs: DataFrame, face_runs: DataFrame, snapshots: DataFrame, limit: int = 20, failed: bool = False) -> DataFrame:
    """The latest ``limit`` (1 to 200) sorting runs with the figures kept when they ended; runs without a snapshot have none and take their totals from the face run."""
    last = runs.where("kind = 'local_sort'").where(F.lit(failed) | F.col("status").isin("running", "completed")).orderBy(F.desc("id")).limit(max(1, min(200, limit)))
    faces = face_runs.select(F.col("id").alias("face_run_id"), "total_files", "processed_files")
    kept = snapshots.withColumnRenamed("run_id", "id").withColumn("kept", F.lit(True))
    rows = last.join(faces, "face_run_id", "left").join(kept, "id", "left")
    figures = [F.when(F.col("kept"), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("cats_total", "cats_mism", "faces_total", "faces_mism", "no_faces_total", "no_faces_mism")]
    source = F.when(F.col("kept"), "snapshot").when(F.col("status") == "running", "pending").otherwise("unavailable")
    return rows.select("id", "status", F.coalesce("step2_total", "total_files").alias("total"), F.coalesce("step2_processed", "processed_files").alias("processed"), *figures, source.alias("source"))


_REPLY = "response struct<GeoObjectCollection: struct<featureMember: array<struct<GeoObject: struct<metaDataProperty: struct<GeocoderMetaData: struct<Address: struct<Components: array<struct<kind: string, name: string>>>>>>>>>>"


def place(reply: Column) -> Column:
    """(country, city) of a geocoder's JSON reply: the first component with a name of kind country, and of kind locality or province; null where absent or unreadable."""
    parts = F.get(F.from_json(reply, _REPLY)["response"]["GeoObjectCollection"]["featureMember"], F.lit(0))["GeoObject"]["metaDataProperty"]["GeocoderMetaData"]["Address"]["Components"]

    def first(*kinds: str) -> Column:
        return F.trim(F.get(F.filter(parts, lambda c: F.lower(F.trim(c["kind"])).isin(*kinds) & (F.trim(c["name"]) != "")), F.lit(0))["name"])

    return F.struct(first("country").alias("country"), first("locality", "province").alias("city"))


def place_year(lat: Column, lon: Column, taken: Column, changed: Column) -> Column:
    """Folder ``gps_lat_lon/year`` by degrees and the day taken, else the time changed; ``unknown`` for what is missing."""
    spot = F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("gps_%.4f_%.4f", lat.cast("double"), lon.cast("double")))
    year = F.coalesce(F.year(taken), F.year(changed)).cast("string")
    return F.concat_ws("/", F.coalesce(spot, F.lit("unknown")), F.coalesce(year, F.lit("unknown")))
