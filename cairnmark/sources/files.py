"""Inventories from folders and listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions of images and videos.
IMAGES = "jpg jpeg png webp bmp tif tiff heic gif".split()
VIDEOS = "mp4 mov avi mkv m4v 3gp webm".split()
#: First bytes of image formats, as patterns of their hexadecimal digits.
MAGIC = {"jpg": "^FFD8", "jpeg": "^FFD8", "png": "^89504E470D0A1A0A", "webp": "^52494646.{8}57454250", "bmp": "^424D", "tif": "^(49492A00|4D4D002A)", "tiff": "^(49492A00|4D4D002A)"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    """image, video or null, by extension."""
    return F.when(extension(path).isin(IMAGES), "image").when(extension(path).isin(VIDEOS), "video")


def scan(spark: SparkSession, root: str, without: list[str] | None = None, hashed: bool = True) -> DataFrame:
    """(path, size, modified, media_type, hash_value, broken) of all files under ``root``.

    Folders below ``root`` named in ``without`` are left out. Without ``hashed`` the bytes are
    not read. ``broken`` marks images whose first bytes are of another format.
    Spark's reader leaves out files of no bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", f"^[a-z]*:?/*\\Q{re.sub('^[a-z]*:?/+', '', root).rstrip('/')}\\E", "")
    for name in without or []:
        found = found.where(~inside.contains(f"/{name}/"))
    rows = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), media_type(F.col("path")).alias("media_type")]
    if not hashed:
        return found.select(*rows)
    magic = F.create_map(*[F.lit(x) for pair in MAGIC.items() for x in pair])
    wanted = F.try_element_at(magic, extension(F.col("path")))
    head = F.hex(F.substring("content", 1, 12))
    return found.select(*rows, F.sha2("content", 256).alias("hash_value"), (wanted.isNotNull() & ~F.regexp(head, wanted)).alias("broken"))


def rescan(spark: SparkSession, root: str, known: DataFrame, without: list[str] | None = None) -> DataFrame:
    """(path, size, modified, media_type, hash_value): bytes are read only of files that ``known`` lacks or has with another size or time."""
    listed = scan(spark, root, without, hashed=False)
    same = known.select("path", "size", "modified", "hash_value").where("hash_value IS NOT NULL")
    kept = listed.join(same, ["path", "size", "modified"]).select("path", "size", "modified", "media_type", "hash_value")
    changed = scan(spark, root, without).join(same, ["path", "size", "modified"], "left_anti")
    return kept.unionByName(changed.select(*kept.columns))


def listing(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """A drive's JSON listing (path, size, modified, sha256, md5) as inventory rows: the hash is sha256, else md5, and files over ``cap`` without either are ``skipped_large``."""
    raw = spark.read.schema("path string, size long, modified string, sha256 string, md5 string").json(path)
    alg = F.when(F.col("sha256").isNotNull(), "sha256").when(F.col("md5").isNotNull(), "md5")
    status = F.when(alg.isNotNull(), "hashed").when(F.col("size") > (cap if cap is not None else F.lit(None).cast("long")), "skipped_large").otherwise("new")
    return raw.select("path", "size", "modified", alg.alias("hash_alg"), F.coalesce("sha256", "md5").alias("hash_value"), status.alias("status"))
