"""What pages of persons, clusters, tabs and trips show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.operators.keyed import merged
from cairnmark.operators.labels import OUTSIDER
from cairnmark.operators.ordering import places
from cairnmark.operators.trips import dated, suggestions

KINDS = ("clusters", "faces_via_clusters", "faces_via_manual", "person_rectangles_files", "file_persons_files")


def _owned(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    return rects.join(clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), F.col("person_id").alias("owner")), "cluster_id", "left")


def person_sources(rects: DataFrame, clusters: DataFrame, file_persons: DataFrame) -> DataFrame:
    """(person_id, file_id, rect_id, route): every way to a person, a row each: faces of the person's clusters, faces and other boxes bound by hand, and files. Ignored boxes give none; a box may come by two routes."""
    live = rects.where(F.coalesce("ignore_flag", F.lit(0)) == 0)
    face = F.col("is_face") == 1
    by_hand = live.where("manual_person_id IS NOT NULL")
    rows = [
        _owned(live, clusters).where(face & F.col("owner").isNotNull()).select(F.col("owner").alias("person_id"), "file_id", F.col("id").alias("rect_id"), F.lit("cluster").alias("route")),
        by_hand.select(F.col("manual_person_id").alias("person_id"), "file_id", F.col("id").alias("rect_id"), F.when(face, "manual_face").otherwise("person_rectangle").alias("route")),
        file_persons.select("person_id", "file_id", F.lit("file").alias("route")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2], allowMissingColumns=True)


def person_totals(persons: DataFrame, rects: DataFrame, clusters: DataFrame, file_persons: DataFrame, files: DataFrame) -> DataFrame:
    """Of every person the distinct clusters, faces and files over five sources, in all, in the archive and in the runs' sources.

    A face bound by hand counts unless it is in a cluster of the same person, where it counts already. ``faces`` is the sum of both.
    Clusters without boxes count in all alone.
    """
    scope = files.select(F.col("id").alias("file_id"), F.col("inventory_scope").alias("scope"))
    live = F.coalesce("ignore_flag", F.lit(0)) == 0
    face = F.col("is_face") == 1
    owned = clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), F.col("person_id").alias("owner"))
    told = _owned(rects, clusters)

    def rows(df, person, item, kind):
        return df.select(F.col(person).alias("person_id"), F.lit(kind).alias("kind"), F.col(item).alias("item"), "file_id")

    by_hand = told.where(live & F.col("manual_person_id").isNotNull())
    counted = (
        rows(owned.join(rects.select("cluster_id", "file_id"), "cluster_id", "left"), "owner", "cluster_id", KINDS[0])
        .unionByName(rows(told.where(live & face & F.col("owner").isNotNull()), "owner", "id", KINDS[1]))
        .unionByName(rows(by_hand.where(face & ~F.col("owner").eqNullSafe(F.col("manual_person_id"))), "manual_person_id", "id", KINDS[2]))
        .unionByName(by_hand.where(F.col("is_face") == 0).select(F.col("manual_person_id").alias("person_id"), F.lit(KINDS[3]).alias("kind"), F.col("file_id").alias("item"), "file_id"))
        .unionByName(file_persons.select("person_id", F.lit(KINDS[4]).alias("kind"), F.col("file_id").alias("item"), "file_id"))
    ).join(scope, "file_id", "left")
    once = counted.groupBy("person_id", "kind", "item").agg(F.max((F.col("scope") == "archive").cast("int")).alias("archive"), F.max((F.col("scope") == "source").cast("int")).alias("run"))
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what).otherwise(0))
    sums = [of(k, F.coalesce(w, F.lit(0))).alias(f"{k}{end}") for k in KINDS for end, w in (("", F.lit(1)), ("_archive", F.col("archive")), ("_run", F.col("run")))]
    by = once.groupBy("person_id").agg(*sums)
    shown = persons.select(F.col("id").alias("person_id"), "name").join(by, "person_id", "left").na.fill(0)
    faces = [(F.col(f"{KINDS[1]}{end}") + F.col(f"{KINDS[2]}{end}")).alias(f"faces{end}") for end in ("", "_archive", "_run")]
    return shown.select("*", *faces, (F.col("person_id") == OUTSIDER).cast("int").alias("is_ignored"))


def outsider_flags(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    """(file_id, manual_only, no_manual) of the files of the outsider: no box of another person, by hand or by its cluster, and one that is the outsider's or nobody's.

    ``manual_only``: no box is the outsider's by its cluster; ``no_manual``: none by hand.
    """
    told = _owned(rects.where(F.coalesce("ignore_flag", F.lit(0)) == 0), clusters)
    hand, owner = F.col("manual_person_id"), F.col("owner")
    one = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    by = told.groupBy("file_id").agg(one((hand != OUTSIDER) | (owner != OUTSIDER)).alias("other"), one((hand == OUTSIDER) | (owner == OUTSIDER) | hand.isNull() & owner.isNull()).alias("outside"), one(owner == OUTSIDER).alias("grouped"), one(hand == OUTSIDER).alias("bound"))
    return by.where("other = 0 AND outside = 1").select("file_id", (1 - F.col("grouped")).alias("manual_only"), (1 - F.col("bound")).alias("no_manual"))


def paged(rows: DataFrame, order: list[Column | str], page: int | None, size: int | None) -> DataFrame:
    """A page (from 1; of 10 to 200 rows, 60 if not said) of ``rows``."""
    size = max(10, min(200, int(size or 60)))
    return rows.orderBy(*order).offset((max(1, int(page or 1)) - 1) * size).limit(size)


def by_place_and_date() -> list[Column]:
    """Places by country and city, files without either last; in a place by the time taken, files without it last; then by path."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [((blank("place_country") == "") & (blank("place_city") == "")).cast("int"), blank("place_country"), blank("place_city"), (blank("taken_at") == "").cast("int"), blank("taken_at"), F.col("path")]


def trip_order(files: DataFrame) -> DataFrame:
    """(id, position) of files (id, trip, taken_at, path): trips by the day of their first file, unknown days first, files in a trip by time and path; files without a trip come last."""
    taken = F.coalesce("taken_at", F.lit(""))
    first = files.where("trip IS NOT NULL").groupBy("trip").agg(F.min(F.struct(taken.alias("taken"), "path")).alias("head"))
    begun = first.select("trip", F.expr("try_cast(substring(head.taken, 1, 10) AS date)").alias("begun"))
    told = files.join(begun, "trip", "left")
    order = [F.col("trip").isNull().cast("int"), F.asc_nulls_first("begun"), F.asc_nulls_first("trip"), taken, "path", "id"]
    return places(told, [], order, "position").select("id", "position")


def clusters_page(clusters: DataFrame, rects: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters with their faces in all, in the archive and in the sources, and the preview: the largest face of the archive, then the surest, then the lowest id."""
    scope = files.select(F.col("id").alias("file_id"), F.col("inventory_scope").alias("scope"))
    faces = rects.where("ignore_flag = 0 AND cluster_id IS NOT NULL").join(scope, "file_id", "left")
    archived = F.col("scope") == "archive"
    best = F.max(F.when(archived, F.struct((F.col("bbox_w") * F.col("bbox_h")).alias("area"), "confidence", (-F.col("id")).alias("neg"))))
    sized = faces.groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.count_if(archived).alias("n_archive"), F.count_if(F.col("scope") == "source").alias("n_run"), best.alias("best"))
    return clusters.join(sized, clusters["id"] == sized["cluster_id"]).select("id", "person_id", "n_faces", "n_archive", "n_run", (-F.col("best.neg")).alias("preview_id"))


def cluster_faces_first(rects: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """(cluster_id, id, rank, n_faces): the first ``limit`` faces of each cluster, those of the archive first, then by area, confidence and id, and how many there are."""
    scope = files.select(F.col("id").alias("file_id"), (F.col("inventory_scope") == "archive").alias("archived"))
    faces = rects.where("ignore_flag = 0 AND cluster_id IS NOT NULL").join(scope, "file_id", "left")
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.coalesce("archived", F.lit(False))), F.desc(F.col("bbox_w") * F.col("bbox_h")), F.desc("confidence"), "id")
    first = faces.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("cluster_id", "id", "rank")
    return first.join(faces.groupBy("cluster_id").agg(F.count("*").alias("n_faces")), "cluster_id")


def cluster_summary(rects: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: clusters of live faces with and without a person, faces in no cluster and their share of all."""
    faces = rects.where("ignore_flag = 0").join(clusters.select(F.col("id").alias("cluster_id"), "person_id"), "cluster_id", "left")
    found = faces.agg(F.countDistinct(F.when(F.col("person_id").isNotNull(), F.col("cluster_id"))).alias("with_person"), F.countDistinct(F.when(F.col("person_id").isNull(), F.col("cluster_id"))).alias("without_person"), F.count_if(F.col("cluster_id").isNull()).alias("noise"), F.count("*").alias("faces"))
    return found.select("*", F.round(F.col("noise") / F.col("faces"), 6).alias("noise_share"))


def largest_unassigned(rects: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """(cluster_id, n_faces) of the ``top`` largest clusters without a person, equals by id."""
    free = clusters.where("person_id IS NULL").select(F.col("id").alias("cluster_id"))
    return rects.where("ignore_flag = 0").join(free, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("n_faces")).orderBy(F.desc("n_faces"), "cluster_id").limit(top)


def marked_by_date(files: DataFrame, trips: DataFrame, trip_files: DataFrame, trip: int, date: str, status: str) -> DataFrame:
    """``trip_files`` (trip_id, file_id, status) after all suggestions of a trip taken on a date (``_no_date``: without one) are included or excluded."""
    day = date.strip().replace("_no_date", "")[:10]
    taken = dated(files).select(F.col("id").alias("file_id"), "day")
    hit = F.col("day") == F.lit(day).cast("date") if day else F.col("day").isNull()
    found = suggestions(files, trips, trip_files).where(F.col("trip_id") == trip).join(taken, "file_id").where(hit)
    return merged(trip_files, found.select("trip_id", "file_id", F.lit(status).alias("status")), ["trip_id", "file_id"], {}).drop("changed")


def moved_to_trips(files: DataFrame, trips: DataFrame, trip_files: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``trip_files`` and ``trips`` (id, start_date, end_date) after ``moves`` (file_id, target): a file leaves the trips that include it as excluded and is included in its target.

    The target's dates grow to hold the files' days; where none of the moved files has one, they are the first and last day of all its files, if any.
    """
    asked = moves.select("file_id", F.col("target").alias("trip_id")).distinct()
    left = trip_files.where("status = 'included'").join(asked.select("file_id").distinct(), "file_id", "left_semi").select("trip_id", "file_id", F.lit("excluded").alias("status"))
    after = merged(merged(trip_files, left, ["trip_id", "file_id"], {}).drop("changed"), asked.select("trip_id", "file_id", F.lit("included").alias("status")), ["trip_id", "file_id"], {}).drop("changed")
    days = dated(files).select(F.col("id").alias("file_id"), "day")
    come = asked.join(days, "file_id").groupBy("trip_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    own = after.where("status = 'included'").join(days, "file_id").groupBy("trip_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    told = trips.join(come.withColumnRenamed("trip_id", "id"), "id", "left").join(own.withColumnRenamed("trip_id", "id"), "id", "left").join(asked.select(F.col("trip_id").alias("id"), F.lit(True).alias("asked")).distinct(), "id", "left")
    start = F.when(F.col("a").isNotNull(), F.least("start_date", "a")).when(F.col("asked"), F.coalesce("first", "start_date")).otherwise(F.col("start_date"))
    end = F.when(F.col("b").isNotNull(), F.greatest("end_date", "b")).when(F.col("asked"), F.coalesce("last", "end_date")).otherwise(F.col("end_date"))
    return after, told.select("id", start.alias("start_date"), end.alias("end_date"))


def included_files(trip_files: DataFrame, files: DataFrame, file_groups: DataFrame, trip: int) -> DataFrame:
    """(file_id, path, run_id, position): photos and videos that a trip includes, by time (unknown last) and path, with the lowest run of their topics."""
    runs = file_groups.groupBy("file_id").agg(F.min("run_id").alias("run_id"))
    shown = files.where("status IS NULL OR status <> 'deleted'").where(F.col("media_type").isin("image", "video"))
    rows = trip_files.where((F.col("trip_id") == trip) & (F.col("status") == "included")).select("file_id").join(shown.select(F.col("id").alias("file_id"), "path", "taken_at"), "file_id").join(runs, "file_id", "left")
    return places(rows, [], [F.asc_nulls_last("taken_at"), "path", "file_id"], "position").select("file_id", "path", "run_id", "position")
