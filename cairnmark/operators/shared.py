"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in a local session (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairnmark.kept.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("cairnmark.kept.dir", f"file://{tempfile.mkdtemp(prefix='spark-cairnmark-')}")
    return spark.conf.get("cairnmark.kept.dir")


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back.

    Unlike a checkpoint it is computed once, and its size is that of its files: sizes that rounds of joins estimate from
    each other grow without bound.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/cairnmark-kept-{uuid.uuid4().hex}"
    _kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has kept, once what was made of them is written elsewhere; how many there were."""
    found = len(_kept)
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
