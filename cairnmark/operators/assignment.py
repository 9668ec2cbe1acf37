"""Faces that join the clusters of their person one after another.

A face joins the cluster of its person whose centroid is nearest, if that is at
most ``most`` away; else it begins a cluster, which the next face may join. So a
person's faces are folded in the order of their ids. The state of a fold is the
sum and count of each cluster's unit vectors, never its members. Persons are
spread over tasks; of one person a round takes ``PIECE`` faces and hands the
state on to the next round as rows, so a large person occupies one task for one
piece at a time, and what a round has done is not done again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.operators.ordering import places
from cairnmark.operators.shared import kept

PIECE, TILE = 50_000, 2048
_STATE = "person_id long, cluster_id long, total array<double>, n long"


def cluster_sums(members: DataFrame) -> DataFrame:
    """(person_id, cluster_id, total, n): the sums of the clusters' unit vectors (person_id, cluster_id, embedding)."""
    at = members.select("person_id", "cluster_id", F.posexplode("embedding").alias("pos", "x")).groupBy("person_id", "cluster_id", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return at.groupBy("person_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


class _Clusters:
    """The clusters of one person: sums, unit centroids and names, those that were there first by id, then as they begin."""

    def __init__(self, dims: int):
        self.names, self.sums, self.centres, self.counts = [], np.zeros((8, dims)), np.zeros((8, dims)), []

    def put(self, name: int, total: np.ndarray, n: int) -> None:
        k = len(self.names)
        if k == len(self.sums):
            self.sums, self.centres = (np.vstack([x, np.zeros_like(x)]) for x in (self.sums, self.centres))
        self.names.append(name)
        self.counts.append(0)
        self.add(k, total, n)

    def add(self, k: int, total: np.ndarray, n: int = 1) -> None:
        self.sums[k] += total
        self.counts[k] += n
        long = np.sqrt(self.sums[k] @ self.sums[k])
        self.centres[k] = self.sums[k] / long if long > 0 else np.nan

    def nearest(self, face: np.ndarray, most: float) -> int | None:
        """Of equally near ones the first; centroids of no direction are near nothing."""
        if not self.names:
            return None
        like = np.round(self.centres[: len(self.names)] @ face, 12)
        like[np.isnan(like)] = -2
        k = int(like.argmax())
        return k if like[k] >= round(1 - most, 12) else None


def _folded(most: float):
    def run(frames):
        person, own = None, None

        def rows_of(person, own):
            if own is None:
                return []
            return [(True, person, None, name, None, own.sums[k].tolist(), own.counts[k], k) for k, name in enumerate(own.names)]

        for pdf in frames:
            out = []
            for p, face, cluster, total, n in zip(pdf["person_id"].tolist(), pdf["id"].tolist(), pdf["cluster_id"].tolist(), pdf["total"], pdf["n"].tolist(), strict=True):
                if p != person:
                    out += rows_of(person, own)
                    person, own = p, _Clusters(len(total))
                total = np.asarray(total, float)
                if cluster == cluster and cluster is not None:
                    own.put(int(cluster), total, int(n))
                    continue
                k = own.nearest(total, most)
                new = k is None
                if new:
                    own.put(-int(face), total, 1)
                    k = len(own.names) - 1
                else:
                    own.add(k, total)
                out.append((False, p, int(face), own.names[k], new, None, None, None))
            if out:
                yield _frame(out)
        out = rows_of(person, own)
        if out:
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["state", "person_id", "id", "cluster_id", "is_new", "total", "n", "seat"])
    return pdf.astype({"id": "Int64", "n": "Int64", "seat": "Int64", "is_new": "boolean"})


def in_order(faces: DataFrame, members: DataFrame, most: float, piece: int = PIECE) -> DataFrame:
    """(id, cluster_id, is_new): each of ``faces`` (id, person_id, embedding) in the cluster that it joins or begins; one begun by face 7 is named -7.

    ``members`` (person_id, cluster_id, embedding) are there before; all vectors are of length 1. Faces of a person go by their ids.
    """
    state = kept(cluster_sums(members).withColumn("seat", F.col("cluster_id")))
    dealt = places(faces.select("id", "person_id", "embedding"), ["person_id"], ["id"]).withColumn("round", F.floor(F.col("place") / piece))
    dealt = kept(dealt.select("round", "person_id", "id", F.col("embedding").alias("total")))
    rounds = dealt.agg(F.max("round")).first()[0]
    found = faces.sparkSession.createDataFrame([], "id long, cluster_id long, is_new int")
    schema = "state boolean, person_id long, id long, cluster_id long, is_new boolean, total array<double>, n long, seat long"
    none = F.lit(None).cast("long")
    for k in range(0 if rounds is None else rounds + 1):
        now = dealt.where(F.col("round") == k)
        there = state.join(now.select("person_id").distinct(), "person_id", "left_semi")
        rows = there.select("person_id", F.col("seat"), none.alias("id"), "cluster_id", "total", "n").unionByName(now.select("person_id", none.alias("seat"), "id", none.alias("cluster_id"), "total", none.alias("n")))
        rows = rows.repartition("person_id").sortWithinPartitions("person_id", F.col("seat").asc_nulls_last(), "id").select("person_id", "id", "cluster_id", "total", "n")
        done = kept(rows.mapInPandas(_folded(most), schema))
        found = found.unionByName(done.where("not state").select("id", "cluster_id", F.col("is_new").cast("int").alias("is_new")))
        state = done.where("state").select("person_id", "cluster_id", "total", "n", "seat")
    return found


def nearest_or_new(faces: DataFrame, members: DataFrame, most: float, tile: int = TILE) -> DataFrame:
    """(id, cluster_id, is_new): each face (id, person_id, embedding) by itself: its person's cluster with the nearest centroid, at most ``most`` away, or one named -id.

    Faces and centroids of a person are dealt into tiles; a pair of tiles is one matrix product in a task.
    """
    long = F.sqrt(F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x))
    centres = cluster_sums(members).withColumn("_long", long).where("_long > 0").select("person_id", F.col("cluster_id").alias("id"), F.transform("total", lambda x: x / F.col("_long")).alias("embedding"))

    def packed(rows, side):
        sizes = rows.groupBy("person_id").agg(F.ceil(F.count("*") / tile).alias("tiles"))
        own = rows.join(sizes, "person_id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        return own.groupBy("person_id", "tile").agg(F.collect_list(F.struct("id", "embedding")).alias(side))

    def compare(frames):
        for pdf in frames:
            for one, two in zip(pdf["a"], pdf["b"], strict=True):
                two = sorted(two, key=lambda r: r["id"])
                x, y = (np.array([r["embedding"] for r in side]) for side in (one, two))
                like = np.round(x @ y.T, 12)
                k = like.argmax(1)
                best = like[np.arange(len(x)), k]
                some = best >= round(1 - most, 12)
                yield pd.DataFrame({"id": np.array([r["id"] for r in one])[some], "unlike": -best[some], "cluster_id": np.array([r["id"] for r in two])[k[some]]})

    pairs = packed(faces.select("id", "person_id", "embedding"), "a").join(packed(centres, "b").select("person_id", "b"), "person_id")
    found = pairs.select("a", "b").mapInPandas(compare, "id long, unlike double, cluster_id long")
    best = found.groupBy("id").agg(F.min(F.struct("unlike", "cluster_id")).alias("best")).select("id", "best.cluster_id")
    return faces.select("id").join(best, "id", "left").select("id", F.coalesce("cluster_id", -F.col("id")).alias("cluster_id"), F.col("cluster_id").isNull().cast("int").alias("is_new"))


def waiting(rects: DataFrame, files: DataFrame) -> DataFrame:
    """Manual faces of archived files that are in no cluster or have no vector yet, and are not ignored."""
    archived = files.where(F.trim(F.coalesce("inventory_scope", F.lit(""))) == "archive").select(F.col("id").alias("file_id"))
    open_ = F.col("manual_person_id").isNotNull() & (F.col("embedding").isNull() | F.col("cluster_id").isNull()) & (F.coalesce("ignore_flag", F.lit(0)) == 0)
    return rects.where(open_).join(archived, "file_id", "left_semi")


def anchors(faces: DataFrame, files: DataFrame) -> DataFrame:
    """(face_id, person_id, archive_scope, run_id): the manual clusters that faces (id, file_id, person_id, run_id, embedding) begin by themselves.

    A face of an archived file has the archive's scope and no run; another the run of the face, else the face run of its file. Faces without a vector, and
    those with neither scope nor run, begin none.
    """
    own = files.select(F.col("id").alias("file_id"), F.trim(F.coalesce("inventory_scope", F.lit(""))).alias("scope"), "faces_run_id")
    archived: Column = F.coalesce(F.col("scope") == "archive", F.lit(False))
    run = F.when(~archived, F.coalesce("run_id", "faces_run_id"))
    found = faces.where("embedding IS NOT NULL").join(own, "file_id", "left").select(F.col("id").alias("face_id"), "person_id", F.when(archived, "archive").alias("archive_scope"), run.alias("run_id"))
    return found.where("archive_scope IS NOT NULL OR run_id IS NOT NULL")
