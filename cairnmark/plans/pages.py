"""Queries behind the pages of persons, clusters, tabs and trips, with their SQL; they register with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnmark.functions import text as X
from cairnmark.operators import curation as C
from cairnmark.operators import inventory as I
from cairnmark.operators import labels as L
from cairnmark.operators import metric as M
from cairnmark.operators import pages as G
from cairnmark.operators import vectors as V
from cairnmark.plans.queries import _CENTRE, _DIST, _KEYS, _LIVE, _ROWS, _SHOWN, _SINGLE, _V2, _VIDEOS, EPS, _centres, _faces, _rounded, _rows, _singles, _videos, query

_RECTS = "(SELECT r.*, CASE WHEN r.id % 13 = 5 THEN 0 ELSE 1 END AS is_face, CASE WHEN r.id % 21 = 0 THEN c.person_id ELSE r.manual_person_id END AS hand, c.person_id AS owner FROM rects r LEFT JOIN clusters c ON c.id = r.cluster_id)"


def _rects(c):
    """Boxes, some of them of whole persons, some bound by hand to their cluster's person."""
    owner = c.clusters.select(F.col("id").alias("cluster_id"), F.col("person_id").alias("_owner"))
    told = c.rects.withColumn("is_face", F.expr("CASE WHEN id % 13 = 5 THEN 0 ELSE 1 END")).join(owner, "cluster_id", "left")
    return told.withColumn("manual_person_id", F.when(F.col("id") % 21 == 0, F.col("_owner")).otherwise(F.col("manual_person_id"))).drop("_owner")


@query(f"SELECT owner AS person_id, file_id, id AS rect_id, 'cluster' AS route FROM {_RECTS} WHERE ignore_flag = 0 AND is_face = 1 AND owner IS NOT NULL UNION ALL SELECT hand, file_id, id, CASE WHEN is_face = 1 THEN 'manual_face' ELSE 'person_rectangle' END FROM {_RECTS} WHERE ignore_flag = 0 AND hand IS NOT NULL UNION ALL SELECT person_id, file_id, NULL, 'file' FROM file_persons")
def person_sources(c):
    return G.person_sources(_rects(c), c.clusters, c.file_persons)


_COUNTED = f"""(SELECT k.person_id, 'clusters' AS kind, k.id AS item, r.file_id FROM clusters k LEFT JOIN rects r ON r.cluster_id = k.id WHERE k.person_id IS NOT NULL UNION ALL SELECT owner, 'faces_via_clusters', id, file_id FROM {_RECTS} WHERE ignore_flag = 0 AND is_face = 1 AND owner IS NOT NULL
  UNION ALL SELECT hand, 'faces_via_manual', id, file_id FROM {_RECTS} WHERE ignore_flag = 0 AND is_face = 1 AND hand IS NOT NULL AND owner IS DISTINCT FROM hand UNION ALL SELECT hand, 'person_rectangles_files', file_id, file_id FROM {_RECTS} WHERE ignore_flag = 0 AND is_face = 0 AND hand IS NOT NULL UNION ALL SELECT person_id, 'file_persons_files', file_id, file_id FROM file_persons)"""
_SUMS = [f"count(DISTINCT CASE WHEN kind = '{k}'{w} THEN item END) AS {k}{end}" for k in G.KINDS for end, w in (("", ""), ("_archive", " AND scope = 'archive'"), ("_run", " AND scope = 'source'"))]


@query(f"SELECT *, faces_via_clusters + faces_via_manual AS faces, faces_via_clusters_archive + faces_via_manual_archive AS faces_archive, faces_via_clusters_run + faces_via_manual_run AS faces_run, CASE WHEN person_id = 6 THEN 1 ELSE 0 END AS is_ignored FROM (SELECT p.id AS person_id, p.name, {', '.join(_SUMS)} FROM persons p LEFT JOIN (SELECT x.*, f.inventory_scope AS scope FROM {_COUNTED} x LEFT JOIN files f ON f.id = x.file_id) y ON y.person_id = p.id GROUP BY p.id, p.name)")
def person_totals(c):
    return G.person_totals(c.persons, _rects(c), c.clusters, c.file_persons, c.files)


@query(f"SELECT file_id, 1 - max(CASE WHEN owner = 6 THEN 1 ELSE 0 END) AS manual_only, 1 - max(CASE WHEN hand = 6 THEN 1 ELSE 0 END) AS no_manual FROM {_RECTS} WHERE ignore_flag = 0 GROUP BY file_id HAVING max(CASE WHEN hand <> 6 OR owner <> 6 THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN hand = 6 OR owner = 6 OR (hand IS NULL AND owner IS NULL) THEN 1 ELSE 0 END) = 1")
def outsider_variants(c):
    return G.outsider_flags(_rects(c), c.clusters)


_BY_PLACE = "CASE WHEN coalesce(place_country, '') = '' AND coalesce(city, '') = '' THEN 1 ELSE 0 END, coalesce(place_country, ''), coalesce(city, ''), CASE WHEN coalesce(taken_at, '') = '' THEN 1 ELSE 0 END, coalesce(taken_at, ''), path"


@query(f"SELECT id, tab FROM (SELECT id, {_V2} AS tab, place_country, CASE WHEN id % 4 = 2 AND id % 8 = 6 THEN NULL ELSE place_city END AS city, taken_at, path FROM {_ROWS}) WHERE tab = 'faces' ORDER BY {_BY_PLACE} LIMIT 10 OFFSET 20")
def tab_page_by_place(c):
    rows = _rows(c).withColumn("tab", L.tab_ui()).where("tab = 'faces'").withColumn("place_city", F.expr("CASE WHEN id % 4 = 2 AND id % 8 = 6 THEN NULL ELSE place_city END"))
    return G.paged(rows, G.by_place_and_date(), 3, 4).select("id", "tab")


_TRIP = "(SELECT id, CASE WHEN place_country <> '' THEN place_country || (id % 7) END AS trip, CASE WHEN id % 7 = 3 AND id % 2 = 0 THEN 'x' || taken_at ELSE taken_at END AS taken_at, path FROM files)"


@query(f"SELECT f.id, row_number() OVER (ORDER BY CASE WHEN f.trip IS NULL THEN 1 ELSE 0 END, b.begun NULLS FIRST, f.trip NULLS FIRST, coalesce(taken_at, ''), path, f.id) - 1 AS position FROM {_TRIP} f LEFT JOIN (SELECT trip, try_cast(substr(first(coalesce(taken_at, '') ORDER BY coalesce(taken_at, ''), path), 1, 10) AS DATE) AS begun FROM {_TRIP} GROUP BY trip) b ON b.trip = f.trip")
def files_by_trip(c):
    trip = F.when(F.col("place_country") != "", F.concat("place_country", (F.col("id") % 7).cast("string")))
    taken = F.expr("CASE WHEN id % 7 = 3 AND id % 2 = 0 THEN concat('x', taken_at) ELSE taken_at END")
    return G.trip_order(c.files.select("id", trip.alias("trip"), taken.alias("taken_at"), "path"))


_FACES = "(SELECT r.*, f.inventory_scope AS scope FROM rects r LEFT JOIN files f ON f.id = r.file_id WHERE r.ignore_flag = 0 AND r.cluster_id IS NOT NULL)"


@query(f"SELECT c.id, c.person_id, n_faces, n_archive, n_run, preview_id FROM clusters c JOIN (SELECT cluster_id, count(*) AS n_faces, count(*) FILTER (scope = 'archive') AS n_archive, count(*) FILTER (scope = 'source') AS n_run, first(id ORDER BY bbox_w * bbox_h DESC, confidence DESC, id) FILTER (scope = 'archive') AS preview_id FROM {_FACES} GROUP BY cluster_id) s ON s.cluster_id = c.id ORDER BY n_faces DESC, c.id LIMIT 20 OFFSET 20")
def cluster_page(c):
    return G.paged(G.clusters_page(c.clusters, c.rects, c.files), [F.desc("n_faces"), "id"], 2, 20)


@query(f"SELECT cluster_id, id, rank, n_faces FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(scope = 'archive', FALSE) DESC, bbox_w * bbox_h DESC, confidence DESC, id) AS rank, count(*) OVER (PARTITION BY cluster_id) AS n_faces FROM {_FACES}) WHERE rank <= 3")
def cluster_faces_first(c):
    return G.cluster_faces_first(c.rects, c.files, 3)


_LIVE_FACES = "(SELECT r.*, c.person_id FROM rects r LEFT JOIN clusters c ON c.id = r.cluster_id WHERE r.ignore_flag = 0)"


@query(f"SELECT count(DISTINCT CASE WHEN person_id IS NOT NULL THEN cluster_id END) AS with_person, count(DISTINCT CASE WHEN person_id IS NULL THEN cluster_id END) AS without_person, count(*) FILTER (cluster_id IS NULL) AS noise, count(*) AS faces, round(count(*) FILTER (cluster_id IS NULL) / count(*), 6) AS noise_share FROM {_LIVE_FACES}")
def cluster_summary(c):
    return G.cluster_summary(c.rects, c.clusters)


@query(f"SELECT cluster_id, count(*) AS n_faces FROM {_LIVE_FACES} WHERE person_id IS NULL AND cluster_id IN (SELECT id FROM clusters) GROUP BY cluster_id ORDER BY n_faces DESC, cluster_id LIMIT 10")
def largest_unassigned(c):
    return G.largest_unassigned(c.rects, c.clusters)


_UNITS = "(SELECT r.*, [x / sqrt(list_dot_product(embedding, embedding)) for x in embedding] AS u, coalesce(r.manual_person_id, c.person_id) AS person FROM rects r LEFT JOIN clusters c ON c.id = r.cluster_id WHERE r.ignore_flag = 0)"


@query(f"SELECT b.id, p.name, round({_DIST}, 6) AS distance FROM (SELECT * FROM {_UNITS} WHERE id = 1) a JOIN {_UNITS} b ON b.id <> a.id AND {_DIST} <= 0.8 LEFT JOIN persons p ON p.id = b.person ORDER BY {_DIST}, b.id LIMIT 7")
def similar_faces(c):
    faces = _faces(c)
    one = faces.where("id = 1").select(F.col("embedding").alias("wanted"))  # one row
    near = faces.where("id <> 1").join(F.broadcast(one)).withColumn("distance", V.distance(F.col("embedding"), F.col("wanted"))).where("distance <= 0.8").orderBy("distance", "id").limit(7)
    person = L.person_of(c.rects, c.clusters).select("id", "person").join(c.persons.select(F.col("id").alias("person"), "name"), "person", "left").select("id", "name")
    return _rounded(near.select("id", "distance").join(person, "id", "left")).select("id", "name", "distance")


_DAYS = "(SELECT *, try_cast(substr(taken_at, 1, 10) AS DATE) AS day FROM files)"
_SUGGESTED = f"(SELECT t.id AS trip_id, f.id AS file_id, f.day FROM trips t JOIN {_DAYS} f ON f.day BETWEEN t.start_date - 1 AND t.end_date + 1 WHERE f.id NOT IN (SELECT file_id FROM trip_files WHERE status = 'included'))"


@query(f"SELECT coalesce(x.trip_id, s.trip_id) AS trip_id, coalesce(x.file_id, s.file_id) AS file_id, coalesce(s.status, x.status) AS status FROM trip_files x FULL JOIN (SELECT trip_id, file_id, 'included' AS status FROM {_SUGGESTED} WHERE trip_id = 2 AND day = DATE '2024-01-15') s ON s.trip_id = x.trip_id AND s.file_id = x.file_id")
def trip_date_attached(c):
    return G.marked_by_date(c.files, c.trips, c.trip_files, 2, " 2024-01-15", "included")


_ASKED = "(SELECT id AS file_id, 1 + id % 3 AS trip_id FROM files WHERE id % 14 = 0)"


@query(f"""SELECT coalesce(a.trip_id, x.trip_id) AS trip_id, coalesce(a.file_id, x.file_id) AS file_id, CASE WHEN a.file_id IS NOT NULL THEN 'included' WHEN x.status = 'included' AND x.file_id IN (SELECT file_id FROM {_ASKED}) THEN 'excluded' ELSE x.status END AS status FROM trip_files x FULL JOIN {_ASKED} a ON a.trip_id = x.trip_id AND a.file_id = x.file_id""")
def files_moved_to_trips(c):
    return _moved(c)[0]


@query(f"SELECT t.id, CASE WHEN m.a IS NULL THEN start_date ELSE least(start_date, m.a) END AS start_date, CASE WHEN m.b IS NULL THEN end_date ELSE greatest(coalesce(end_date, m.b), m.b) END AS end_date FROM trips t LEFT JOIN (SELECT trip_id, min(day) AS a, max(day) AS b FROM {_ASKED} q JOIN {_DAYS} d ON d.id = q.file_id GROUP BY trip_id) m ON m.trip_id = t.id")
def trips_after_moves(c):
    return _moved(c)[1]


def _moved(c):
    moves = c.files.where("id % 14 = 0").select(F.col("id").alias("file_id"), (1 + F.col("id") % 3).alias("target"))
    return G.moved_to_trips(c.files, c.trips.select("id", "start_date", "end_date"), c.trip_files, moves)


@query("SELECT f.id AS file_id, f.path, g.run_id, row_number() OVER (ORDER BY f.taken_at NULLS LAST, f.path, f.id) - 1 AS position FROM trip_files t JOIN files f ON f.id = t.file_id LEFT JOIN (SELECT file_id, min(created % 5) AS run_id FROM file_groups GROUP BY file_id) g ON g.file_id = f.id WHERE t.trip_id = 3 AND t.status = 'included' AND coalesce(f.status, '') <> 'deleted'")
def trip_files_with_run(c):
    return G.included_files(c.trip_files, c.files, c.file_groups.withColumn("run_id", F.col("created") % 5), 3)


_DETECTED = "(SELECT id, bbox_x * 3 + id % 5 AS x, bbox_y * 4 AS y, bbox_w + 0.5 AS w, bbox_h AS h, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END AS scale, 200 AS width, 150 AS height FROM rects)"
_SCALED = f"(SELECT *, greatest(0, CAST(round_even(x / scale, 0) AS BIGINT)) AS xi, greatest(0, CAST(round_even(y / scale, 0) AS BIGINT)) AS yi, greatest(0, CAST(round_even(w / scale, 0) AS BIGINT)) AS wi, greatest(0, CAST(round_even(h / scale, 0) AS BIGINT)) AS hi FROM {_DETECTED} WHERE scale > 0 AND scale <> 1)"


@query(f"""SELECT id, xi AS x, yi AS y, least(wi, width - xi) AS w, least(hi, height - yi) AS h FROM {_SCALED} WHERE xi < width AND yi < height AND least(wi, width - xi) > 1 AND least(hi, height - yi) > 1
  UNION ALL SELECT id, CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(trunc(w) AS BIGINT), CAST(h AS BIGINT) FROM {_DETECTED} WHERE scale <= 0 OR scale = 1""")
def boxes_scaled_back(c):
    found = c.rects.select("id", (F.col("bbox_x") * 3 + F.col("id") % 5).alias("x"), (F.col("bbox_y") * 4).alias("y"), (F.col("bbox_w") + 0.5).alias("w"), F.col("bbox_h").alias("h"), F.expr("CASE id % 4 WHEN 0 THEN 1.0D WHEN 1 THEN 0.5D WHEN 2 THEN 0.25D ELSE 0.0D END AS scale"))
    box = X.scaled_back(*(F.col(k) for k in ("x", "y", "w", "h", "scale")), F.lit(200), F.lit(150))
    return found.select("id", box.alias("box")).where("box IS NOT NULL").select("id", "box.*")


_BOUND = "(SELECT r.id AS face_id, r.cluster_id, c.person_id FROM rects r JOIN clusters c ON c.id = r.cluster_id WHERE c.person_id IS NOT NULL)"


@query(f"SELECT person_id, face_id, cluster_id, CASE WHEN face_id % 4 <> 1 THEN 'cluster' ELSE 'restored_from_snapshot' END AS source, CASE WHEN face_id % 4 <> 1 THEN 0.5 ELSE 0.9 END AS confidence FROM {_BOUND} WHERE face_id % 4 <> 1 OR face_id % 3 = 0")
def restored_faces(c):
    owned = c.clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), "person_id")
    faces = c.rects.select(F.col("id").alias("face_id"), "cluster_id").join(owned, "cluster_id")
    labels = faces.where("face_id % 4 <> 1").select("person_id", "face_id", "cluster_id", F.lit("cluster").alias("source"), F.lit(0.5).alias("confidence"))
    return C.restored(labels, faces.where("face_id % 3 = 0"))


@query(f"SELECT face_id, cluster_id, p.name, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY distance, cluster_id) AS n FROM (SELECT a.id AS face_id, b.cluster_id, {_DIST} AS distance FROM {_SINGLE} a JOIN {_CENTRE} b ON {_DIST} <= {EPS} WHERE b.cluster_id IN (SELECT id FROM clusters WHERE person_id <> 6))) x JOIN clusters k ON k.id = x.cluster_id LEFT JOIN persons p ON p.id = k.person_id WHERE n = 1")
def closest_person_cluster(c):
    owned = c.clusters.where(F.col("person_id") != L.OUTSIDER).select("id", "person_id")
    centres = _centres(c).join(owned.select("id"), "id", "left_semi")
    found = M.nearest_within(_singles(c), centres, EPS).withColumnRenamed("b", "cluster_id")
    named = owned.join(c.persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left").select(F.col("id").alias("cluster_id"), "name")
    return _rounded(found.join(named, "cluster_id")).select(F.col("a").alias("face_id"), "cluster_id", "name", "distance")


@query(f"SELECT p.algorithm, p.value, f.id, f.path, g.n FROM (SELECT algorithm, value, count(*) AS n FROM files JOIN {_SHOWN} ON file_id = id WHERE {_LIVE} GROUP BY algorithm, value HAVING count(*) > 1) g JOIN phashes p ON p.algorithm = g.algorithm AND p.value = g.value JOIN files f ON f.id = p.file_id WHERE {_LIVE}")
def similar_image_members(c):
    live = I.live_archive(c.files)
    return I.similar_image_members(live, c.phashes, I.similar_images(live, c.phashes, "phash", c.hidden_similar))


@query(f"SELECT g.duration, g.key, f.id, f.path, g.n FROM {_VIDEOS} g JOIN {_KEYS} k ON k.duration = g.duration AND k.key = g.key JOIN files f ON f.id = k.file_id WHERE {_LIVE}")
def similar_video_members(c):
    return I.similar_video_members(I.live_archive(c.files), c.frame_hashes, _videos(c))


@query(f"SELECT r.id, coalesce(s.cluster_id, r.cluster_id) AS cluster_id FROM rects r LEFT JOIN (SELECT face_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY distance, cluster_id) AS n FROM (SELECT a.id AS face_id, b.cluster_id, {_DIST} AS distance FROM {_SINGLE} a JOIN {_CENTRE} b ON {_DIST} <= {EPS})) WHERE n = 1) s ON s.face_id = r.id")
def assigned_memberships(c):
    near = M.nearest_within(_singles(c), _centres(c), EPS).select(F.col("a").alias("id"), F.col("b").alias("to"))
    return c.rects.select("id", "cluster_id").join(near, "id", "left").select("id", F.coalesce("to", "cluster_id").alias("cluster_id"))


@query("SELECT id, name FROM (SELECT id, folder AS name, CASE WHEN id % 2 = 0 THEN 'disk' ELSE 'local' END AS location, CASE id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'source' END AS role, CASE id % 5 WHEN 0 THEN ' Image' WHEN 1 THEN 'VIDEO ' WHEN 2 THEN 'text' WHEN 3 THEN NULL ELSE media_type END AS kind FROM files) WHERE location = 'disk' AND role = 'target' AND lower(trim(kind)) IN ('image', 'video')")
def target_folders_listed(c):
    rows = c.files.select("id", F.col("folder").alias("name"), F.expr("CASE WHEN id % 2 = 0 THEN 'disk' ELSE 'local' END AS location"), F.expr("CASE id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'source' END AS role"), F.expr("CASE id % 5 WHEN 0 THEN ' Image' WHEN 1 THEN 'VIDEO ' WHEN 2 THEN 'text' WHEN 3 THEN NULL ELSE media_type END AS kind"))
    return I.listed_folders(rows, "disk", "target").where(I.is_media(F.col("kind"))).select("id", "name")


@query("SELECT id, CASE WHEN starts_with(path, 'local:') THEN substr(path, 7) ELSE path END AS bare, CASE WHEN starts_with(path, 'disk:') THEN path ELSE CASE WHEN starts_with(path, 'local:') THEN path ELSE 'local:' || path END END AS marked FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(path, 'local:', '') ELSE path END AS path FROM files)")
def marked_paths(c):
    path = F.when(F.col("id") % 3 == 0, F.regexp_replace("path", "local:", "")).otherwise(F.col("path"))
    return c.files.select("id", I.bare_path(path).alias("bare"), I.local_path(path).alias("marked"))
