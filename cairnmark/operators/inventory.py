"""Inventory upkeep and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_archive(scope: Column) -> Column:
    """Null scope counts as archive (inventory queries)."""
    return F.coalesce(scope, F.lit("archive")) == "archive"


def in_source(scope: Column) -> Column:
    """Null scope does not count as source."""
    return F.coalesce(scope, F.lit("")) == "source"


def live_archive(files: DataFrame) -> DataFrame:
    """Archive files not deleted; a null status is not known to be live and is left out."""
    return files.where(in_archive(F.col("inventory_scope")) & (F.col("status") != "deleted"))


def duplicate_groups(files: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(hash_alg, hash_value, n) of hashes with more than one of ``files``, without hidden ones."""
    hashed = files.where("hash_alg IS NOT NULL AND hash_value IS NOT NULL AND trim(hash_value) <> ''")
    if hidden is not None:
        hashed = hashed.join(hidden, hashed["hash_value"] == hidden["value"], "left_anti")
    return hashed.groupBy("hash_alg", "hash_value").agg(F.count("*").alias("n")).where("n > 1")


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with the same keys; the named columns keep the old value where the new one is null."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in keep_old_if_null:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def last_written(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def reconcile(catalogue: DataFrame, crawl: DataFrame) -> DataFrame:
    """(path, action) of a crawl (path, size) against the catalogue (path, size, status): missing files are deleted, changed ones hashed again, deleted ones that are back restored."""
    c, f = catalogue.select("path", F.col("size").alias("known_size"), "status", F.lit(True).alias("known")), crawl.select("path", "size", F.lit(True).alias("seen"))
    action = (
        F.when(F.col("known").isNull(), "insert").when(F.col("seen").isNull() & F.col("status").eqNullSafe("deleted"), "keep_deleted").when(F.col("seen").isNull(), "delete")
        .when(F.col("status").eqNullSafe("deleted"), "restore").when(~F.col("size").eqNullSafe(F.col("known_size")), "rehash").otherwise("keep")
    )
    return c.join(f, "path", "full_outer").select("path", action.alias("action"))


def keep_selection(files: DataFrame, folder_order: DataFrame) -> DataFrame:
    """Of each duplicate group the file to keep: largest, then first folder (unknown last), then path; (hash_value, id, is_keep)."""
    groups = duplicate_groups(files).select("hash_value")
    members = files.join(groups, "hash_value").join(folder_order, "folder", "left")
    w = Window.partitionBy("hash_value").orderBy(F.desc("size"), F.coalesce("sort_order", F.lit(999999)), "path")
    return members.select("hash_value", "id", (F.row_number().over(w) == 1).cast("int").alias("is_keep"))


def later_copies(files: DataFrame) -> DataFrame:
    """Files that a file of an earlier path (same hash) makes superfluous."""
    w = Window.partitionBy("hash_value").orderBy("path")
    return files.where("hash_value IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n > 1").select("id", "path", "hash_value")


def copies_in_archive(files: DataFrame, run: int, prefixes: list[str]) -> DataFrame:
    """(source_id, archive_id, hash_value) of source files of ``run`` whose content the live archive has below one of the folders ``prefixes``; files that ignore copies in this run are left out."""
    below = F.lit(False)
    for prefix in filter(str.strip, prefixes):
        below = below | F.col("path").startswith(prefix.rstrip("/") + "/")
    wanted = in_source(F.col("inventory_scope")) & (F.col("last_run_id") == run) & (F.col("status") != "deleted") & (F.coalesce("ignore_archive_dup_run_id", F.lit(-1)) != run)
    s = files.where(wanted).select(F.col("id").alias("source_id"), "hash_alg", "hash_value")
    a = live_archive(files).where(below).select(F.col("id").alias("archive_id"), "hash_alg", "hash_value")
    return s.join(a, ["hash_alg", "hash_value"]).select("source_id", "archive_id", "hash_value")


def similar_images(files: DataFrame, phashes: DataFrame, algorithm: str, hidden: DataFrame | None = None) -> DataFrame:
    """(algorithm, value, n, first_id) of perceptual hashes of more than one of ``files``, without ``hidden`` groups (algorithm, value)."""
    hashed = phashes.where(F.col("algorithm") == algorithm)
    if hidden is not None:
        hashed = hashed.join(hidden, ["algorithm", "value"], "left_anti")
    return files.join(hashed, files["id"] == hashed["file_id"]).groupBy("algorithm", "value").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def video_keys(frames: DataFrame) -> DataFrame:
    """(file_id, duration, key): the first three frame hashes in order of time of each video that has as many."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("offset_sec", "value"))), 1, 3)
    keys = frames.groupBy("file_id", "duration").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))
    return keys.where(F.size("values") == 3).select("file_id", "duration", F.array_join("values", "|").alias("key"))


def similar_videos(files: DataFrame, frames: DataFrame, hidden: DataFrame) -> DataFrame:
    """(duration, key, n) of keys that more than one of ``files`` has, without ``hidden`` groups (duration, key)."""
    live = frames.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    groups = video_keys(live).groupBy("duration", "key").agg(F.count("*").alias("n")).where("n > 1")
    return groups.join(hidden, ["duration", "key"], "left_anti")


def folder_counts(files: DataFrame, depth: int = 2) -> DataFrame:
    """Files under each path prefix of up to ``depth`` segments."""
    parts = F.split("path", "/")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return files.select(prefixes.alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def similar_image_members(files: DataFrame, phashes: DataFrame, groups: DataFrame) -> DataFrame:
    """(algorithm, value, id, path, n): the files of each of ``groups`` (algorithm, value, n)."""
    shown = phashes.join(groups.select("algorithm", "value", "n"), ["algorithm", "value"])
    return files.select("id", "path").join(shown, F.col("id") == shown["file_id"]).select("algorithm", "value", "id", "path", "n")


def similar_video_members(files: DataFrame, frames: DataFrame, groups: DataFrame) -> DataFrame:
    """(duration, key, id, path, n): the files of each of ``groups`` (duration, key, n)."""
    keyed = video_keys(frames).join(groups.select("duration", "key", "n"), ["duration", "key"])
    return files.select("id", "path").join(keyed, F.col("id") == keyed["file_id"]).select("duration", "key", "id", "path", "n")


def listed_folders(folders: DataFrame, location: str | None = None, role: str | None = None) -> DataFrame:
    """Folders (location, role, ...) of a location and a role, where these are asked for."""
    for column, wanted in (("location", location), ("role", role)):
        if wanted is not None:
            folders = folders.where(F.col(column) == wanted)
    return folders


def is_media(media_type: Column) -> Column:
    """Whether a file is a photo or a video by its type, in any case, white space aside."""
    return F.coalesce(F.lower(F.trim(media_type)).isin("image", "video"), F.lit(False))


def local_path(path: Column) -> Column:
    """A path of this machine with its mark; paths with a mark stay."""
    return F.when(path.startswith("local:") | path.startswith("disk:"), path).otherwise(F.concat(F.lit("local:"), path))


def bare_path(path: Column) -> Column:
    """A path of this machine without its mark."""
    return F.when(path.startswith("local:"), F.substr(path, F.lit(7))).otherwise(path)
