"""Places of rows in an order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.shared import kept


def places(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, among the rows of equal ``keys`` in the order of ``order``.

    Rows lie in ranges of (keys, order); a row's place is that in its range, plus what earlier ranges hold of its keys. Keys may be
    null; without keys all rows are one group, of which one task adds up a count for each range.
    """
    by = [*keys, *order]
    spread = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    ran = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = spread.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = kept(runs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(ran), F.lit(0)) - F.col("_first")).alias("_shift")))
    same = spread["_part"] == runs["_p"]
    for i, k in enumerate(keys):
        same = same & spread[k].eqNullSafe(runs[f"_k{i}"])
    return spread.join(runs, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*rows.columns, name)
