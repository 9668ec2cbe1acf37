"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that all executors share; where it is unset in a local session (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairnmark.shared.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.conf.set("cairnmark.shared.dir", f"file://{tempfile.mkdtemp(prefix='spark-cairnmark-')}")
    return spark.conf.get("cairnmark.shared.dir")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder, so that nothing before it is computed again."""
    spark = df.sparkSession
    directory = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(directory)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``cut`` for large tables: a compressed Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cairnmark-{name}-{uuid.uuid4().hex}"
    _written.append((path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """As ``written``, in buckets by ``column``: a later join or cogroup on it needs no shuffle of the table."""
    spark = df.sparkSession
    table = f"cairnmark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    _written.append((path, table))
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def release_tables(spark: SparkSession) -> int:
    """Ends the tables that this process has written or registered, once what was made of them is written elsewhere; how many there were. A token store is among them."""
    found = len(_written)
    while _written:
        path, table = _written.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found
