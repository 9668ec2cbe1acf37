"""Centroids, links between clusters, components and cluster maintenance over embeddings.

Vectors of a person are dealt into tiles, tiles are paired, and a pair of tiles
is one matrix product in a task. Search without such a key is in ``metric``,
density clustering in ``density``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.shared import kept

TILE = 2048


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1; empty ones, zeros and those with NaN are left out."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).withColumn("_norm", norm).where("_norm > 0 AND NOT isnan(_norm)")
    # the norm is bound before the inner loop: as a column it would be taken again for each entry
    scaled = F.transform(F.array("_norm"), lambda n: F.transform("embedding", lambda x: x / n))
    return usable.withColumn("embedding", F.element_at(scaled, 1)).drop("_norm")


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of two unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(members: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the unit mean of the unit vectors of each key."""
    at = members.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    mean = at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))
    return unit(mean)


def nearest(pairs: DataFrame, by: str, other: str) -> DataFrame:
    """The closest ``other`` of each ``by``; of equals the lowest."""
    w = Window.partitionBy(by).orderBy("distance", other)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cluster_links(members: DataFrame, most: float, tile: int = TILE) -> DataFrame:
    """(c1, c2, distance): the smallest distance of members (id, cluster_id, person_id, embedding) of two clusters of one person, at most ``most``; c1 < c2.

    Tiles are made within a person, so faces of different persons are never
    compared; a task keeps the smallest distance of two clusters in its tiles.
    """
    sizes = members.groupBy("person_id").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    own = members.join(sizes, "person_id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    packed = own.groupBy("person_id", "tiles", "tile").agg(F.collect_list(F.struct("cluster_id", "embedding")).alias("a"))
    left = packed.select("person_id", "a", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("j"))
    right = packed.select("person_id", F.col("tile").alias("j"), F.col("a").alias("b"))

    def compare(frames):
        for pdf in frames:
            for one, two in zip(pdf["a"], pdf["b"], strict=True):
                x, y = (np.array([r["embedding"] for r in side]) for side in (one, two))
                p, q = (np.array([r["cluster_id"] for r in side], np.int64) for side in (one, two))
                d = 1 - x @ y.T
                r, c = np.nonzero((d <= most) & (p[:, None] != q[None, :]))
                out = pd.DataFrame({"c1": np.minimum(p[r], q[c]), "c2": np.maximum(p[r], q[c]), "distance": d[r, c]})
                yield out.groupby(["c1", "c2"], as_index=False)["distance"].min()

    found = left.join(right, ["person_id", "j"]).select("a", "b").mapInPandas(compare, "c1 long, c2 long, distance double")
    return found.groupBy("c1", "c2").agg(F.min("distance").alias("distance"))


def _sizes(members: DataFrame, cluster: str, size: str) -> DataFrame:
    return members.groupBy(F.col("cluster_id").alias(cluster)).agg(F.count("*").alias(size))


def small_merges(members: DataFrame, most: float, size: int) -> DataFrame:
    """(source, target, distance): links of two clusters of a person that both have at most ``size`` members, from the smaller; of equals from the second."""
    few = members.join(_sizes(members, "cluster_id", "_n").where(F.col("_n") <= size).select("cluster_id"), "cluster_id", "left_semi")
    links = cluster_links(few, most).join(_sizes(few, "c1", "n1"), "c1").join(_sizes(few, "c2", "n2"), "c2")
    first = F.col("n1") < F.col("n2")
    return links.select(F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("source"), F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("target"), "distance")


def best_merges(members: DataFrame, most: float, size: int) -> DataFrame:
    """(source, target, distance): for each cluster of at most ``size`` members the nearest of its person's others, of any size."""
    links = cluster_links(members, most)
    both = links.select(F.col("c1").alias("source"), F.col("c2").alias("target"), "distance").union(links.select("c2", "c1", "distance"))
    return nearest(both.join(_sizes(members, "source", "_n").where(F.col("_n") <= size).select("source"), "source", "left_semi"), "source", "target")


def outliers(members: DataFrame, key: str, threshold: float) -> DataFrame:
    """(id, key, distance) of members further than ``threshold`` from their key's centroid, of keys with two or more."""
    several = members.groupBy(key).count().where("count > 1").select(key)
    own = members.join(several, key)
    centre = centroids(own, key).withColumnRenamed("embedding", "centre")
    return own.join(centre, key).select("id", key, distance(F.col("embedding"), F.col("centre")).alias("distance")).where(F.col("distance") > threshold)


def connected(edges: DataFrame, checkpoint=kept) -> DataFrame:
    """(node, root) over links (a, b), by handing on the smallest neighbour and jumping to its root."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        low = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(low, roots["node"] == low["a"]).select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = checkpoint(step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = step.where("next < root").limit(1).count()
        roots = step.select("node", F.col("next").alias("root"))
        if not changed:
            return roots


def numbered(rows: DataFrame, key: str, checkpoint=kept) -> DataFrame:
    """(key, number) of distinct keys counted from 0 in their order: within ranges of keys, after the count of the ranges before (one row for each range)."""
    placed = checkpoint(rows.select(key).repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    before = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = placed.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(key)))
    return inside.join(before, "range").select(key, (F.col("before") + F.col("place") - 1).alias("number"))


def adjusted_rand(rows: DataFrame) -> DataFrame:
    """(ari) of the columns ``truth`` and ``label``."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = rows.groupBy("truth", "label").agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("x"), F.sum("n").alias("all"))
    one = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(pairs("n").alias("t"))
    two = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs("n").alias("l"))
    joined = both.join(one).join(two)  # one row each
    expected = F.col("t") * F.col("l") / (F.col("all") * (F.col("all") - 1) / 2)
    return joined.select(F.round((F.col("x") - expected) / ((F.col("t") + F.col("l")) / 2 - expected), 6).alias("ari"))
