"""Search for any part of a text in a list, page after page.

The index of a list has its entries with their places in its order, and for
every three successive characters of an entry, in lower case, its place
(postings, stored in the order of these characters, so that Parquet's statistics
prune them). A pattern of three characters or more reads the postings of its
rarest threes alone and looks at the entries that have all of them; a shorter one
looks at every entry. A page begins after the place of the entry that ended the
one before, if that entry is found at all; else at the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.operators.ordering import places
from cairnmark.operators.shared import kept

GRAM, RAREST, LEAST, MOST = 3, 4, 10, 300


def grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text; none of a shorter one."""
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass
class Index:
    """``entries`` (place, entry, low), ``postings`` (gram, place) and ``counts`` (gram, n)."""

    entries: DataFrame
    postings: DataFrame
    counts: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, order: list[Column | str]) -> Index:
        """The index of ``rows`` (entry, ...) in the order of ``order``; null entries are left out."""
        entries = kept(places(rows.where("entry IS NOT NULL"), [], order).select("place", "entry", F.lower("entry").alias("low")))
        postings = entries.select(F.explode(grams(F.col("low"))).alias("gram"), "place")
        postings = kept(postings.repartitionByRange("gram", "place").sortWithinPartitions("gram", "place"))
        return cls(entries, postings, kept(postings.groupBy("gram").agg(F.count("*").alias("n"))))

    def found(self, wanted: str) -> DataFrame:
        """(place, entry) of the entries that hold ``wanted``, without its outer white space, in any case."""
        low = wanted.strip().lower()
        hits = self.entries.where(F.col("low").contains(low)).select("place", "entry")
        parts = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not parts:
            return hits
        sizes = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(parts)).collect()}  # at most the pattern's length
        if len(sizes) < len(parts):
            return hits.where(F.lit(False))
        rarest = sorted(parts, key=lambda g: (sizes[g], g))[:RAREST]
        some = self.postings.where(F.col("gram").isin(rarest)).groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("place")
        return hits.join(some, "place", "left_semi")

    def page(self, wanted: str, after: str | None = None, limit: int = 80) -> DataFrame:
        """(place, entry, total, more): at most ``limit`` (10 to 300) found entries after the entry ``after``, how many there are in all and whether some follow the page."""
        limit, found = max(LEAST, min(MOST, limit)), self.found(wanted)
        after = (after or "").strip()
        begin = found.where(F.col("entry") == after).agg(F.min("place")).first()[0] if after else None
        rest = found if begin is None else found.where(F.col("place") > begin)
        total = found.count()
        some = rest.orderBy("place").limit(limit + 1)
        page = some.orderBy("place").limit(limit)
        return page.select("place", "entry", F.lit(total).alias("total"), F.lit(some.count() > limit).alias("more"))
