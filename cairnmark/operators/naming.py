"""The first free name of each newcomer among those already at its destination.

A newcomer takes its own name if that is free, else ``stem (n).ext`` with the
least free n, one newcomer after the other. So of the newcomers of one name the
r-th takes the r-th number that is not occupied (0: the name itself). An
occupied number with j smaller ones shifts all newcomers from number - j on;
in the order of these thresholds and the newcomers' ranks, a newcomer's place is
its number. Three numberings within ranges give it, however many share a name.

Newcomers of different names meet where one is named like another's numbered
name (``a.jpg`` and ``a (1).jpg``). Such families alone are settled one name
after the other, by a task that holds the family's names.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.operators.ordering import places

_NUMBERED = r" \(([1-9][0-9]{0,17})\)$"
_PARTS = re.compile(r"^(.*?)(\.[^.]*)?$", re.S)


def stem_of(name: str) -> Column:
    return F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1)


def extension_of(name: str) -> Column:
    return F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 2)


def numbered_name(stem: Column, number: Column, ext: Column) -> Column:
    return F.concat(stem, F.when(number == 0, "").otherwise(F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))), ext)


def _settle(frames):
    family, taken, following = None, set(), {}
    for pdf in frames:
        out = []
        for key, name, row in zip(pdf["family"].tolist(), pdf["name"].tolist(), pdf["row"].tolist(), strict=True):
            if key != family:
                family, taken, following = key, set(), {}
            if row is None or row != row:
                taken.add(name)
                continue
            stem, ext = _PARTS.match(name).groups("")
            n = following.get(name, 0)
            while (found := name if n == 0 else f"{stem} ({n}){ext}") in taken:
                n += 1
            following[name] = n + 1
            taken.add(found)
            out.append((int(row), found))
        if out:
            yield pd.DataFrame(out, columns=["row", "unique_name"])


def free_names(rows: DataFrame, there: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (folder, name, ...) in the order of ``order`` with ``unique_name``, the first free one in the folder; ``there`` (folder, name) is occupied. Rows without a name get none."""
    with_row = places(rows, [], order, "row")
    parts = lambda df: df.withColumn("stem", stem_of("name")).withColumn("ext", extension_of("name")).withColumn("family", F.to_json(F.array(F.coalesce("folder", F.lit("")), F.regexp_replace("stem", r"( \([1-9][0-9]{0,17}\))+$", ""), "ext")))
    new = parts(with_row.where("name IS NOT NULL").select("row", "folder", "name"))
    old = parts(there.where("name IS NOT NULL").select("folder", "name").distinct()).join(new.select("family").distinct(), "family", "left_semi")
    mixed = new.groupBy("family").agg(F.countDistinct("name").alias("n")).where("n > 1").select("family")

    both = old.join(mixed, "family", "left_semi").select("family", "name", F.lit(None).cast("long").alias("row")).unionByName(new.join(mixed, "family", "left_semi").select("family", "name", "row"))
    settled = both.repartition("family").sortWithinPartitions("family", F.col("row").asc_nulls_first()).mapInPandas(_settle, "row long, unique_name string")

    alone = places(new.join(mixed, "family", "left_anti"), ["family", "name"], ["row"], "r")
    names = alone.select("family", "name").distinct().select("family", "name", F.col("name").alias("own"))
    own = F.col("name") == F.col("own")
    tail = F.regexp_extract("stem", _NUMBERED, 1)
    numbered = F.concat(stem_of("own"), F.lit(" ("), tail, F.lit(")"), extension_of("own"))
    met = old.join(names.select("family", "own"), "family").withColumn("number", F.when(own, 0).when((tail != "") & (F.col("name") == numbered), tail.cast("long"))).where("number IS NOT NULL")
    held = places(met.select("family", F.col("own").alias("name"), "number"), ["family", "name"], ["number"], "j")
    line = held.select("family", "name", (F.col("number") - F.col("j")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "number").unionByName(alone.select("family", "name", F.col("r").alias("at"), F.lit(1).alias("kind"), "row", F.lit(None).cast("long").alias("number")))
    dealt = places(line, ["family", "name"], ["at", "kind", "number"], "place").where("kind = 1")
    free = dealt.select("row", numbered_name(stem_of("name"), F.col("place"), extension_of("name")).alias("unique_name"))
    return with_row.join(free.unionByName(settled), "row", "left").drop("row")
