"""Upserts with a rule for each column, into tables kept in parts by key.

``merged`` is the join. ``KeyedTable`` keeps its rows as Parquet folders, one
for each part of the keys' hash; a merge reads and writes the parts alone that
the new rows change, and commits by one file that lists the folders of all
parts, created under the next number. A reader takes the last list and so sees a
merge as a whole or not at all; of two merges that began from one list the later
one fails and leaves nothing but folders that no list names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a column becomes where old and new rows meet: the new value; the new value unless null; the old value.
NEW, FILLED, OLD = "new", "filled", "old"


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str], last: list[str] | None = None) -> DataFrame:
    """``old`` after the upsert of ``new``, and ``changed``: whether a row is not as it was.

    Columns without a rule take the new value. Of new rows of one key the greatest by ``last`` counts (by all columns, if not
    given). Keys may be null and meet as equals.
    """
    columns = [c for c in old.columns if c not in keys]
    order = F.struct(*(last or columns)) if last or columns else F.lit(0)
    one = new.select(*old.columns).groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_new")) if columns else new.select(*keys).distinct().withColumn("_new", F.struct(F.lit(1)))
    have = old.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*columns).alias("_old") if columns else F.struct(F.lit(1)).alias("_old"))
    same = F.lit(True)
    for k in keys:
        same = same & one[k].eqNullSafe(have[f"_{k}"])
    both = have.join(one, same, "full_outer")
    met, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c):
        now, was = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        then = {NEW: now, FILLED: F.coalesce(now, was), OLD: was}[rules.get(c, NEW)]
        return F.when(met & fresh, then).when(fresh, now).otherwise(was)

    result = both.select(*(F.when(met, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys), *(value(c).alias(c) for c in columns), "_old", met.alias("_met"))
    as_before = F.lit(True)
    for c in columns:
        as_before = as_before & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return result.withColumn("changed", ~(F.col("_met") & as_before)).select(*old.columns, "changed")


@dataclass
class KeyedTable:
    """A table at ``path`` with ``keys``, in ``parts`` parts, of rows of ``schema``."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    parts: int = 64

    def _store(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *names]))

    def _list(self) -> tuple[int, dict[int, str]]:
        """The last list's number (0: none) and its folders by part."""
        store, at = self._store()
        if not store.exists(at("lists")):
            return 0, {}
        number = max((int(s.getPath().getName()) for s in store.listStatus(at("lists")) if s.getPath().getName().isdigit()), default=0)
        if not number:
            return 0, {}
        text = "".join(r.value for r in self.spark.read.text(at("lists", str(number)).toString()).collect())  # one line for each part at most
        return number, {int(k): v for k, v in json.loads(text).items()}

    def _rows(self, folders: dict[int, str], some: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path.rstrip('/')}/{v}" for k, v in sorted(folders.items()) if some is None or k in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self._rows(self._list()[1])

    def merge(self, new: DataFrame, rules: dict[str, str], last: list[str] | None = None) -> list[int]:
        """Upserts ``new`` and commits; the parts that were written, none if nothing changed."""
        number, folders = self._list()
        touched = [r.part for r in new.select(self._part().alias("part")).distinct().collect()]  # ``parts`` at most
        result = merged(self._rows(folders, touched), new, self.keys, rules, last).withColumn("_part", self._part())
        changed = sorted(r["_part"] for r in result.where("changed").select("_part").distinct().collect())
        if not changed:
            return []
        name = f"rows/{uuid.uuid4().hex}"
        result.where(F.col("_part").isin(changed)).drop("changed").repartition("_part").write.partitionBy("_part").parquet(f"{self.path.rstrip('/')}/{name}")
        folders = folders | {k: f"{name}/_part={k}" for k in changed}
        store, at = self._store()
        store.mkdirs(at("lists"))
        out = store.create(at("lists", str(number + 1)), False)  # fails if another merge was first
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return changed
