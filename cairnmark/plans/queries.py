"""Every registered query with the SQL that the tests hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmark.functions import text as X
from cairnmark.operators import density as D
from cairnmark.operators import gold as G
from cairnmark.operators import inventory as I
from cairnmark.operators import labels as L
from cairnmark.operators import metric as M
from cairnmark.operators import persons as P
from cairnmark.operators import routing as R
from cairnmark.operators import trips as T
from cairnmark.operators import vectors as V
from cairnmark.operators.ordering import places
from cairnmark.plans.fixtures import Catalogue, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UNEXPRESSED: set[str] = set()
EPS = 0.65
BOX = ["file_id", "bbox_x", "bbox_y"]

_LIVE = "coalesce(inventory_scope, 'archive') = 'archive' AND status <> 'deleted'"
FOLDERS = [f"disk:/src{k}" for k in range(0, 20, 2)]
_BELOW = "(" + " OR ".join(f"starts_with(path, '{f}/')" for f in FOLDERS) + ")"
_PERSON = "(SELECT r.*, coalesce(r.manual_person_id, c.person_id) AS person FROM rects r LEFT JOIN clusters c ON c.id = r.cluster_id WHERE r.ignore_flag = 0)"
_PAIRS = f"(SELECT DISTINCT file_id, person_id FROM (SELECT file_id, person AS person_id FROM {_PERSON} WHERE person IS NOT NULL UNION ALL SELECT file_id, person_id FROM file_persons) WHERE person_id <> 6)"
_ROWS = f"""(SELECT f.*, m.faces_label, coalesce(m.people_no_face, 0) = 1 AS pnf, coalesce(m.animals, 0) = 1 OR f.animals_auto = 1 AS animal, coalesce(m.quarantine, 0) = 1 AS quar, b.file_id IS NOT NULL AS bound,
    f.auto_quarantine = 1 AND f.faces_count > 0 AS autoq, f.auto_quarantine = 1 AND f.faces_count > 0 AND f.quarantine_reason <> 'many_small_faces' AS autoqx
  FROM files f LEFT JOIN manual_labels m ON m.file_id = f.id LEFT JOIN (SELECT DISTINCT file_id FROM {_PAIRS}) b ON b.file_id = f.id WHERE coalesce(f.status, '') <> 'deleted')"""
_COUNT = "CASE WHEN faces_count > 0 THEN 'faces' ELSE 'no_faces' END"
_V1 = f"CASE WHEN pnf THEN 'people_no_face' WHEN faces_label IS NOT NULL THEN faces_label WHEN quar AND faces_count > 0 THEN 'quarantine' WHEN animal THEN 'animals' WHEN autoqx THEN 'quarantine' ELSE {_COUNT} END"
_V2 = f"CASE WHEN pnf OR coalesce(faces_label, '') = 'faces' OR bound THEN 'faces' WHEN coalesce(faces_label, '') = 'no_faces' OR quar THEN 'no_faces' WHEN animal THEN 'animals' WHEN autoqx THEN 'no_faces' ELSE {_COUNT} END"
_V3P = f"CASE WHEN pnf THEN 'people_no_face' WHEN faces_label IS NOT NULL THEN faces_label WHEN quar AND faces_count > 0 THEN 'quarantine' WHEN animal THEN 'animals' WHEN autoq THEN 'quarantine' ELSE {_COUNT} END"
_V3 = f"CASE WHEN bound AND {_V3P} IN ('no_faces', 'people_no_face', 'quarantine') THEN 'faces' ELSE {_V3P} END"
_UNIT = "(SELECT *, [x / sqrt(list_dot_product(embedding, embedding)) for x in embedding] AS u FROM rects WHERE ignore_flag = 0)"
_DIST = "1 - list_dot_product(a.u, b.u)"


def query(sql: str):
    def keep(f: Callable[[Catalogue], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        SQL[name] = with_tables(sql)
        return f

    return keep


def unexpressed(f: Callable[[Catalogue], DataFrame]):
    """Registers a query that SQL can't express; tests hold its operator against plain loops."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
    UNEXPRESSED.add(f.__name__)
    return f


def _rows(c: Catalogue) -> DataFrame:
    return L.labelled(c.files, c.manual_labels, _pairs(c))


def _pairs(c: Catalogue) -> DataFrame:
    return L.bindings(c.rects, c.clusters, c.file_persons)


def _faces(c: Catalogue) -> DataFrame:
    """Detections not ignored with unit vectors."""
    return V.unit(c.rects.where("ignore_flag = 0"))


# Inventory and duplicates


@query(f"SELECT hash_alg, hash_value, count(*) AS n FROM files WHERE {_LIVE} AND hash_value IS NOT NULL AND hash_value NOT IN (SELECT value FROM hidden_groups) GROUP BY hash_alg, hash_value HAVING count(*) > 1")
def dup_groups_archive(c):
    return I.duplicate_groups(I.live_archive(c.files), c.hidden_groups)


@query("SELECT hash_alg, hash_value, count(*) AS n FROM files WHERE coalesce(inventory_scope, '') = 'source' AND last_run_id = 1 AND status <> 'deleted' AND hash_value IS NOT NULL GROUP BY hash_alg, hash_value HAVING count(*) > 1")
def dup_groups_run(c):
    return I.duplicate_groups(c.files.where(I.in_source(F.col("inventory_scope")) & (F.col("last_run_id") == 1) & (F.col("status") != "deleted")))


@query(f"SELECT id, path, hash_value, n FROM files JOIN (SELECT hash_value, count(*) AS n FROM files WHERE {_LIVE} AND hash_value IS NOT NULL GROUP BY hash_value HAVING count(*) > 1) g USING (hash_value) WHERE {_LIVE}")
def dup_group_members(c):
    live = I.live_archive(c.files)
    return live.join(I.duplicate_groups(live).select("hash_value", "n"), "hash_value").select("id", "path", "hash_value", "n")


@query(f"SELECT s.id AS source_id, a.id AS archive_id, s.hash_value FROM files s JOIN (SELECT * FROM files WHERE {_LIVE} AND {_BELOW}) a ON a.hash_alg = s.hash_alg AND a.hash_value = s.hash_value WHERE coalesce(s.inventory_scope, '') = 'source' AND s.status <> 'deleted' AND s.last_run_id = 1 AND coalesce(s.ignore_archive_dup_run_id, -1) <> 1")
def source_dups_in_archive(c):
    return I.copies_in_archive(c.files, 1, FOLDERS)


@query(f"SELECT s.id AS source_id, count(*) AS n, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id) AS archive_ids FROM files s JOIN (SELECT * FROM files WHERE {_LIVE} AND {_BELOW}) a ON a.hash_alg = s.hash_alg AND a.hash_value = s.hash_value WHERE coalesce(s.inventory_scope, '') = 'source' AND s.status <> 'deleted' AND s.last_run_id = 1 AND coalesce(s.ignore_archive_dup_run_id, -1) <> 1 GROUP BY s.id")
def source_dups_nested(c):
    return I.copies_in_archive(c.files, 1, FOLDERS).groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("archive_id")), lambda x: x.cast("string")), ",").alias("archive_ids"))


_SHOWN = "(SELECT * FROM phashes WHERE algorithm = 'phash' AND (algorithm, value) NOT IN (SELECT (algorithm, value) FROM hidden_similar))"


@query(f"SELECT algorithm, value, count(*) AS n, min(id) AS first_id FROM files JOIN {_SHOWN} ON file_id = id WHERE {_LIVE} GROUP BY algorithm, value HAVING count(*) > 1")
def similar_image_groups(c):
    return I.similar_images(I.live_archive(c.files), c.phashes, "phash", c.hidden_similar)


@query("SELECT algorithm, value, count(*) AS n, min(id) AS first_id FROM files JOIN phashes ON file_id = id WHERE coalesce(inventory_scope, '') = 'source' AND last_run_id = 1 AND status <> 'deleted' AND algorithm = 'phash' GROUP BY algorithm, value HAVING count(*) > 1")
def similar_image_groups_run(c):
    return I.similar_images(c.files.where(I.in_source(F.col("inventory_scope")) & (F.col("last_run_id") == 1) & (F.col("status") != "deleted")), c.phashes, "phash")


@query(f"SELECT DISTINCT value FROM phashes JOIN files ON id = file_id WHERE coalesce(inventory_scope, '') = 'source' AND value IN (SELECT value FROM phashes JOIN files ON id = file_id WHERE {_LIVE})")
def similar_source_vs_archive(c):
    keys = lambda files: c.phashes.join(files, F.col("file_id") == F.col("id")).select("value")
    return keys(c.files.where(I.in_source(F.col("inventory_scope")))).intersect(keys(I.live_archive(c.files)))


_KEYS = "(SELECT file_id, duration, string_agg(value, '|' ORDER BY offset_sec) AS key FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY offset_sec) AS n FROM frame_hashes) WHERE n <= 3 GROUP BY file_id, duration HAVING count(*) = 3)"
_VIDEOS = f"(SELECT duration, key, count(*) AS n FROM {_KEYS} WHERE file_id IN (SELECT id FROM files WHERE {_LIVE}) AND (duration, key) NOT IN (SELECT (duration, key) FROM {_KEYS} WHERE file_id % 35 = 4) GROUP BY duration, key HAVING count(*) > 1)"


def _videos(c: Catalogue) -> DataFrame:
    hidden = I.video_keys(c.frame_hashes.where("file_id % 35 = 4")).select("duration", "key").distinct()
    return I.similar_videos(I.live_archive(c.files), c.frame_hashes, hidden)


@query(f"SELECT * FROM {_VIDEOS}")
def similar_video_groups(c):
    return _videos(c)


_ORDER = "(SELECT folder, CAST(row_number() OVER (ORDER BY folder) AS BIGINT) AS sort_order FROM (SELECT DISTINCT folder FROM files WHERE folder < 'src15'))"


@query(f"SELECT hash_value, id, CASE WHEN row_number() OVER (PARTITION BY hash_value ORDER BY size DESC, coalesce(sort_order, 999999), path) = 1 THEN 1 ELSE 0 END AS is_keep FROM files JOIN (SELECT hash_value FROM files WHERE hash_value IS NOT NULL GROUP BY hash_value HAVING count(*) > 1) g USING (hash_value) LEFT JOIN {_ORDER} o USING (folder)")
def keep_selection(c):
    order = places(c.files.where("folder < 'src15'").select("folder").distinct(), [], ["folder"], "before").select("folder", (F.col("before") + 1).alias("sort_order"))
    return I.keep_selection(c.files, order)


@query("SELECT id, path, hash_value FROM (SELECT *, row_number() OVER (PARTITION BY hash_value ORDER BY path) AS n FROM files WHERE hash_value IS NOT NULL) WHERE n > 1")
def first_seen_moves(c):
    return I.later_copies(c.files)


@query(f"SELECT id, path FROM files WHERE {_LIVE} AND hash_value IS NULL")
def missing_hash(c):
    return I.live_archive(c.files).where("hash_value IS NULL").select("id", "path")


@query(f"SELECT id, path FROM files WHERE {_LIVE} AND media_type = 'image' AND id NOT IN (SELECT file_id FROM phashes)")
def missing_phash(c):
    return I.live_archive(c.files).where("media_type = 'image'").join(c.phashes, F.col("id") == F.col("file_id"), "left_anti").select("id", "path")


@query(f"SELECT id, path, coalesce(n, 0) AS n FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM frame_hashes GROUP BY file_id) h ON file_id = id WHERE {_LIVE} AND media_type = 'video' AND coalesce(n, 0) < 3")
def videos_lt3_hashes(c):
    n = c.frame_hashes.groupBy("file_id").agg(F.count("*").alias("n"))
    return I.live_archive(c.files).where("media_type = 'video'").join(n, F.col("id") == F.col("file_id"), "left").select("id", "path", F.coalesce("n", F.lit(0)).alias("n")).where("n < 3")


@query(f"SELECT 'exact' AS kind, count(*) AS n_groups, coalesce(max(n), 0) AS largest FROM (SELECT count(*) AS n FROM files WHERE {_LIVE} AND hash_value IS NOT NULL GROUP BY hash_value HAVING count(*) > 1) UNION ALL SELECT 'image', count(*), coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM files JOIN {_SHOWN} ON file_id = id WHERE {_LIVE} GROUP BY algorithm, value HAVING count(*) > 1) UNION ALL SELECT 'video', count(*), coalesce(max(n), 0) FROM {_VIDEOS}")
def duplicates_summary(c):
    live = I.live_archive(c.files)
    kinds = {"exact": I.duplicate_groups(live), "image": I.similar_images(live, c.phashes, "phash", c.hidden_similar), "video": _videos(c)}
    parts = [g.agg(F.count("*").alias("n_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).select(F.lit(k).alias("kind"), "n_groups", "largest") for k, g in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CRAWL = "(SELECT path, CASE WHEN id % 8 = 1 THEN size + 1 ELSE size END AS size FROM files WHERE id % 6 <> 5 UNION ALL SELECT path || '.new', size FROM files WHERE id % 31 = 0)"


@query(f"SELECT coalesce(f.path, k.path) AS path, CASE WHEN f.path IS NULL THEN 'insert' WHEN k.path IS NULL AND f.status = 'deleted' THEN 'keep_deleted' WHEN k.path IS NULL THEN 'delete' WHEN f.status = 'deleted' THEN 'restore' WHEN f.size <> k.size THEN 'rehash' ELSE 'keep' END AS action FROM files f FULL JOIN {_CRAWL} k ON f.path = k.path")
def reconcile_inventory(c):
    crawl = c.files.where("id % 6 <> 5").select("path", F.expr("CASE WHEN id % 8 = 1 THEN size + 1 ELSE size END AS size")).union(c.files.where("id % 31 = 0").select(F.concat("path", F.lit(".new")), "size"))
    return I.reconcile(c.files, crawl)


@query("SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN o.size ELSE n.size END AS size, coalesce(n.hash_value, o.hash_value) AS hash_value FROM (SELECT path, size, hash_value FROM files WHERE id % 3 <> 0) o FULL JOIN (SELECT path, size * 2 AS size, CASE WHEN id % 4 = 0 THEN 'new' END AS hash_value FROM files WHERE id % 2 = 0) n ON n.path = o.path")
def upsert_files(c):
    old = c.files.where("id % 3 <> 0").select("path", "size", "hash_value")
    new = c.files.where("id % 2 = 0").select("path", (F.col("size") * 2).alias("size"), F.expr("CASE WHEN id % 4 = 0 THEN 'new' END AS hash_value"))
    return I.keyed_merge(old, new, ["path"], ["hash_value"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_writer(c):
    return I.last_written(c.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT value FROM hidden_groups UNION SELECT hash_value FROM files WHERE id % 15 = 0 AND hash_value IS NOT NULL")
def hide_groups(c):
    return I.insert_absent(c.hidden_groups, c.files.where("id % 15 = 0 AND hash_value IS NOT NULL").select(F.col("hash_value").alias("value")).distinct(), ["value"])


@query("SELECT prefix, count(*) AS n FROM (SELECT split_part(path, '/', 1) AS prefix FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files) GROUP BY prefix")
def folder_counts(c):
    return I.folder_counts(c.files)


# Labels and tabs


@query(f"SELECT id, {_V1} AS tab FROM {_ROWS}")
def effective_tab_metrics(c):
    return _rows(c).select("id", L.tab_metrics().alias("tab"))


@query(f"SELECT id, {_V2} AS tab FROM {_ROWS}")
def effective_tab_ui(c):
    return _rows(c).select("id", L.tab_ui().alias("tab"))


@query(f"SELECT id, {_V3} AS tab FROM {_ROWS}")
def effective_tab_routing(c):
    return _rows(c).select("id", L.tab_routing().alias("tab"))


@query(f"SELECT id, CASE WHEN faces_label = 'faces' THEN 2 WHEN faces_label = 'no_faces' THEN 0 WHEN autoq THEN 1 WHEN pnf THEN 4 WHEN faces_count = 0 AND animal THEN 3 WHEN faces_count > 0 THEN 2 ELSE 0 END AS code FROM {_ROWS}")
def effective_tab_split(c):
    return _rows(c).select("id", L.code_split().alias("code"))


@query(f"SELECT id, CASE WHEN animals_auto = 1 THEN 'animals' WHEN autoqx THEN 'quarantine' ELSE {_COUNT} END AS tab FROM {_ROWS}")
def effective_tab_auto(c):
    return _rows(c).select("id", L.tab_auto().alias("tab"))


@query(f"SELECT id, CASE WHEN bound THEN 1 ELSE 0 END AS bound FROM {_ROWS}")
def person_binding_flag(c):
    return _rows(c).select("id", F.col("bound").cast("int").alias("bound"))


_UNSORTED = "NOT bound AND faces_label IS NULL"


@query(f"SELECT count(*) FILTER (tab = 'faces') AS faces, count(*) FILTER (tab = 'no_faces') AS no_faces, count(*) FILTER (tab = 'animals') AS animals, count(*) FILTER (faces_count >= 8) AS many_faces, count(*) FILTER ({_UNSORTED}) AS unsorted, count(*) FILTER ({_UNSORTED} AND media_type = 'image') AS unsorted_photos, count(*) FILTER ({_UNSORTED} AND media_type = 'video') AS unsorted_videos FROM (SELECT *, {_V2} AS tab FROM {_ROWS})")
def tab_counts(c):
    return L.tab_counts(_rows(c))


@query(f"SELECT file_id, count(*) AS n_unassigned FROM {_PERSON} WHERE person IS NULL GROUP BY file_id")
def unassigned_face_files(c):
    return L.person_of(c.rects, c.clusters).where("person IS NULL").groupBy("file_id").agg(F.count("*").alias("n_unassigned"))


@query(f"SELECT id FROM {_ROWS} WHERE faces_count >= 8 AND NOT bound")
def many_faces_unassigned(c):
    return _rows(c).where((F.col("faces_count") >= L.MANY) & ~F.col("bound")).select("id")


@query(f"SELECT id FROM {_ROWS} WHERE {_UNSORTED} AND id NOT IN (SELECT file_id FROM file_groups)")
def unsorted_files(c):
    return _rows(c).where(~F.col("bound") & F.col("faces_label").isNull()).join(c.file_groups, F.col("id") == F.col("file_id"), "left_anti").select("id")


@query(f"SELECT file_id FROM {_PERSON} GROUP BY file_id HAVING count(*) FILTER (person IS NOT NULL AND person <> 6) = 0")
def outsider_files(c):
    return L.outsider_files(c.rects, c.clusters)


@query(f"SELECT file_id FROM {_PAIRS} WHERE person_id = 3")
def person_files(c):
    return _pairs(c).where("person_id = 3").select("file_id")


@query(f"SELECT id, tab FROM (SELECT id, {_V2} AS tab, place_country, taken_at, path FROM {_ROWS}) WHERE tab = 'no_faces' ORDER BY CASE WHEN place_country = '' THEN 1 ELSE 0 END, place_country, taken_at NULLS LAST, path LIMIT 50 OFFSET 50")
def tab_page(c):
    tab = _rows(c).withColumn("tab", L.tab_ui()).where("tab = 'no_faces'")
    return tab.orderBy(F.when(F.col("place_country") == "", 1).otherwise(0), "place_country", F.asc_nulls_last("taken_at"), "path").offset(50).limit(50).select("id", "tab")


@query("SELECT coalesce(k.file_id, n.file_id) AS file_id, coalesce(nullif(trim(n.faces_label), ''), k.faces_label) AS faces_label, greatest(coalesce(k.animals, 0), coalesce(n.animals, 0)) AS animals FROM (SELECT * FROM manual_labels WHERE file_id % 4 <> 1) k FULL JOIN (SELECT file_id, CASE WHEN file_id % 5 = 0 THEN ' ' ELSE faces_label END AS faces_label, 1 - animals AS animals FROM manual_labels WHERE file_id % 3 = 0) n ON n.file_id = k.file_id")
def manual_label_merge(c):
    moved = c.manual_labels.where("file_id % 3 = 0").select("file_id", F.expr("CASE WHEN file_id % 5 = 0 THEN ' ' ELSE faces_label END AS faces_label"), (1 - F.col("animals")).alias("animals"))
    return L.merge_labels(c.manual_labels.where("file_id % 4 <> 1"), moved)


@query("SELECT id, taken_at FROM files WHERE coalesce(taken_at, '') >= '2024-01-10' AND coalesce(taken_at, '') <= '2024-01-20'")
def date_window(c):
    at = F.coalesce("taken_at", F.lit(""))
    return c.files.where((at >= "2024-01-10") & (at <= "2024-01-20")).select("id", "taken_at")


@query("SELECT id, path FROM files WHERE starts_with(lower(path), 'disk:/src1')")
def prefix_files(c):
    return c.files.where(F.lower("path").startswith("disk:/src1")).select("id", "path")


# Persons and clusters


@query(f"SELECT person_id, name, n_files FROM (SELECT person_id, count(*) AS n_files FROM {_PAIRS} GROUP BY person_id UNION ALL SELECT 6, count(*) FROM (SELECT file_id FROM {_PERSON} GROUP BY file_id HAVING count(*) FILTER (person IS NOT NULL AND person <> 6) = 0)) JOIN persons ON persons.id = person_id WHERE n_files > 0")
def persons_with_files(c):
    return P.persons_with_files(c.persons, c.rects, c.clusters, c.file_persons)


@query(f"SELECT p.id, p.name, count(r.id) FILTER (r.cluster_id IS NOT NULL) AS via_clusters, count(r.id) FILTER (r.cluster_id IS NULL) AS via_manual, count(DISTINCT r.cluster_id) AS n_clusters, count(DISTINCT CASE WHEN f.inventory_scope = 'archive' THEN f.id END) AS archive_files, count(DISTINCT CASE WHEN f.inventory_scope = 'source' THEN f.id END) AS source_files FROM persons p LEFT JOIN {_PERSON} r ON r.person = p.id LEFT JOIN files f ON f.id = r.file_id GROUP BY p.id, p.name")
def persons_stats(c):
    return P.person_stats(c.persons, c.rects, c.clusters, c.files)


@query("SELECT c.id, c.person_id, c.scope, n_faces, n_files, preview_id FROM clusters c JOIN (SELECT cluster_id, count(*) AS n_faces, count(DISTINCT file_id) AS n_files, max(CASE WHEN n = 1 THEN id END) AS preview_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY bbox_w * bbox_h DESC, confidence DESC, id) AS n FROM rects WHERE ignore_flag = 0 AND cluster_id IS NOT NULL) GROUP BY cluster_id) s ON s.cluster_id = c.id")
def cluster_list(c):
    return P.cluster_list(c.clusters, c.rects)


@query("SELECT cluster_id, id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY bbox_w * bbox_h DESC, confidence DESC, id) AS n FROM rects WHERE ignore_flag = 0 AND cluster_id IS NOT NULL) WHERE n <= 3")
def cluster_preview(c):
    return P.cluster_faces(c.rects, 3)


@query("SELECT DISTINCT person_id, file_id, route FROM (SELECT c.person_id, r.file_id, 'cluster' AS route FROM rects r JOIN clusters c ON c.id = r.cluster_id WHERE r.ignore_flag = 0 AND c.person_id IS NOT NULL UNION ALL SELECT manual_person_id, file_id, 'manual' FROM rects WHERE ignore_flag = 0 AND manual_person_id IS NOT NULL UNION ALL SELECT person_id, file_id, 'file' FROM file_persons)")
def person_items(c):
    return P.person_items(c.rects, c.clusters, c.file_persons)


@query("SELECT id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, bbox_x % 2, frame_idx ORDER BY CASE WHEN cluster_id IS NULL THEN 1 ELSE 0 END, id DESC) AS n FROM rects) WHERE n = 1")
def file_faces_dedup(c):
    rects = c.rects.withColumn("side", F.col("bbox_x") % 2)
    return P.distinct_boxes(rects, [F.col("cluster_id").isNull(), F.desc("id")], ["file_id", "side", "frame_idx"]).select("id", "file_id")


@query(f"SELECT file_id, person, count(*) AS n FROM {_PERSON} WHERE person IS NOT NULL AND person <> 6 GROUP BY file_id, person HAVING count(*) > 1")
def duplicate_person_check(c):
    return P.repeated_persons(c.rects, c.clusters)


@query("SELECT id, round(bbox_w * bbox_h / sum(bbox_w * bbox_h) OVER (PARTITION BY file_id), 6) AS score FROM rects")
def presence_score(c):
    return P.presence(c.rects)


@query("SELECT file_id, max(frame_idx) + 1 AS next_index FROM rects GROUP BY file_id")
def next_face_index(c):
    return c.rects.groupBy("file_id").agg((F.coalesce(F.max("frame_idx"), F.lit(-1)) + 1).alias("next_index"))


@query("SELECT r.file_id, min(frame_idx) AS frame_idx FROM rects r JOIN files f ON f.id = r.file_id WHERE f.media_type = 'video' AND ignore_flag = 0 GROUP BY r.file_id")
def first_markup_frame(c):
    return c.rects.where("ignore_flag = 0").join(c.files.where("media_type = 'video'").select(F.col("id").alias("file_id")), "file_id").groupBy("file_id").agg(F.min("frame_idx").alias("frame_idx"))


@query("SELECT group_name, min(coalesce(group_order, 999)) AS first_order, string_agg(name, ',' ORDER BY name) AS names FROM persons GROUP BY group_name")
def person_groups(c):
    return c.persons.groupBy("group_name").agg(F.min(F.coalesce("group_order", F.lit(999))).alias("first_order"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("SELECT group_path, count(DISTINCT file_id) AS n_files, max(created) AS last_created FROM file_groups GROUP BY group_path")
def topic_groups(c):
    return P.topic_groups(c.file_groups)


@query(f"SELECT group_path, count(DISTINCT file_id) AS n_files, max(created) AS last_created FROM file_groups WHERE file_id IN (SELECT id FROM {_ROWS} WHERE {_V2} = 'no_faces') GROUP BY group_path")
def topic_groups_no_faces(c):
    rows = _rows(c).where(L.tab_ui() == "no_faces").select(F.col("id").alias("file_id"))
    return P.topic_groups(c.file_groups.join(rows, "file_id", "left_semi"))


@query("SELECT cluster_id, person, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, person) AS k FROM (SELECT cluster_id, id % 10 AS person, count(*) AS n FROM rects WHERE cluster_id IS NOT NULL GROUP BY 1, 2)) WHERE k = 1")
def majority_person(c):
    return P.majority_person(c.rects, c.clusters, F.col("id") % 10)


@query(f"SELECT f.id, CASE WHEN n IS NULL THEN '_unassigned' WHEN n > 1 THEN '_mixed' ELSE name END AS folder FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, min(person_id) AS person_id FROM {_PAIRS} GROUP BY file_id) b ON b.file_id = f.id LEFT JOIN persons ON persons.id = b.person_id")
def people_folder_split(c):
    return P.one_person_folder(c.files, _pairs(c), c.persons)


# Vectors

_SINGLE = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n_in FROM (SELECT u.*, c.person_id FROM " + _UNIT + " u JOIN clusters c ON c.id = u.cluster_id)) WHERE n_in = 1 AND person_id IS NULL)"
_OWNED = "(SELECT u.*, c.person_id FROM " + _UNIT + " u JOIN clusters c ON c.id = u.cluster_id WHERE c.person_id IS NOT NULL)"
_CENTRE = "(SELECT cluster_id, [x / sqrt(list_dot_product(m, m)) for x in m] AS u FROM (SELECT cluster_id, list(x ORDER BY i) AS m FROM (SELECT cluster_id, i, avg(u[i]) AS x FROM (SELECT cluster_id, u, unnest(range(1, len(u) + 1)) AS i FROM " + _OWNED + ") GROUP BY cluster_id, i) GROUP BY cluster_id))"


def _owned(c: Catalogue) -> DataFrame:
    return _faces(c).join(c.clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), "person_id"), "cluster_id")


def _singles(c: Catalogue) -> DataFrame:
    from pyspark.sql import Window

    free = _faces(c).join(c.clusters.select(F.col("id").alias("cluster_id"), "person_id"), "cluster_id")
    return free.withColumn("n_in", F.count("*").over(Window.partitionBy("cluster_id"))).where("n_in = 1 AND person_id IS NULL")


def _centres(c: Catalogue) -> DataFrame:
    return V.centroids(_owned(c), "cluster_id").withColumnRenamed("cluster_id", "id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query(f"SELECT b.id, round({_DIST}, 6) AS distance FROM (SELECT * FROM {_UNIT} WHERE id = 1) a JOIN {_UNIT} b ON b.id <> a.id ORDER BY {_DIST}, b.id LIMIT 10")
def cosine_topk(c):
    faces = _faces(c)
    one = faces.where("id = 1").select(F.col("embedding").alias("wanted"))  # one row
    near = faces.where("id <> 1").join(F.broadcast(one)).select("id", V.distance(F.col("embedding"), F.col("wanted")).alias("distance"))
    return _rounded(near.orderBy("distance", "id").limit(10))


@query(f"SELECT cluster_id, len(u) AS size, round(u[1], 6) AS x1, round(u[64], 6) AS x64 FROM {_CENTRE}")
def cluster_centroids(c):
    return _centres(c).select(F.col("id").alias("cluster_id"), F.size("embedding").alias("size"), F.round(F.element_at("embedding", 1), 6).alias("x1"), F.round(F.element_at("embedding", 64), 6).alias("x64"))


@query(f"SELECT face_id, cluster_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY distance, cluster_id) AS n FROM (SELECT a.id AS face_id, b.cluster_id, {_DIST} AS distance FROM {_SINGLE} a JOIN {_CENTRE} b ON {_DIST} <= {EPS})) WHERE n = 1")
def nearest_cluster(c):
    return _rounded(M.nearest_within(_singles(c), _centres(c), EPS)).select(F.col("a").alias("face_id"), F.col("b").alias("cluster_id"), "distance")


@query(f"SELECT face_id, cluster_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY distance, cluster_id) AS n FROM (SELECT a.id AS face_id, b.cluster_id, min({_DIST}) AS distance FROM {_SINGLE} a JOIN {_OWNED} b ON {_DIST} <= {EPS} GROUP BY a.id, b.cluster_id)) WHERE n = 1")
def nearest_by_min_distance(c):
    members = _owned(c).select(F.col("cluster_id").alias("id"), "embedding")
    return _rounded(M.nearest_within(_singles(c), members, EPS)).select(F.col("a").alias("face_id"), F.col("b").alias("cluster_id"), "distance")


@query(f"SELECT a.id AS a, b.id AS b, round({_DIST}, 6) AS distance FROM {_SINGLE} a JOIN {_SINGLE} b ON a.id < b.id AND {_DIST} <= {EPS}")
def similar_single_pairs(c):
    return _rounded(M.close_pairs(_singles(c), None, EPS))


_LINKS = f"(SELECT a.cluster_id AS c1, b.cluster_id AS c2, min({_DIST}) AS distance FROM {_OWNED} a JOIN {_OWNED} b ON a.person_id = b.person_id AND a.cluster_id < b.cluster_id AND {_DIST} <= 0.8 GROUP BY 1, 2)"


_SIZE = f"(SELECT cluster_id, count(*) AS n FROM {_OWNED} GROUP BY cluster_id)"
SMALL = 4


@query(f"SELECT CASE WHEN s1.n < s2.n THEN c1 ELSE c2 END AS source, CASE WHEN s1.n < s2.n THEN c2 ELSE c1 END AS target, round(distance, 6) AS distance FROM {_LINKS} JOIN {_SIZE} s1 ON s1.cluster_id = c1 JOIN {_SIZE} s2 ON s2.cluster_id = c2 WHERE s1.n <= {SMALL} AND s2.n <= {SMALL}")
def merge_small_clusters(c):
    return _rounded(V.small_merges(_owned(c), 0.8, SMALL))


@query(f"SELECT source, target, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target) AS n FROM (SELECT c1 AS source, c2 AS target, distance FROM {_LINKS} UNION ALL SELECT c2, c1, distance FROM {_LINKS})) r WHERE r.n = 1 AND source IN (SELECT cluster_id FROM {_SIZE} WHERE n <= {SMALL})")
def merge_optimal_clusters(c):
    return _rounded(V.best_merges(_owned(c), 0.8, SMALL))


@query(f"SELECT a.id, a.cluster_id, round({_DIST}, 6) AS distance FROM {_OWNED} a JOIN {_CENTRE} b ON a.cluster_id = b.cluster_id WHERE {_DIST} > 0.6 AND a.cluster_id IN (SELECT cluster_id FROM {_OWNED} GROUP BY cluster_id HAVING count(*) > 1)")
def centroid_outliers(c):
    return _rounded(V.outliers(_owned(c).select("id", "cluster_id", "embedding"), "cluster_id", 0.6))


@query(f"SELECT a.id, a.person_id, round({_DIST}, 6) AS distance FROM {_OWNED} a JOIN {_CENTRE.replace('cluster_id, i', 'person_id, i').replace('SELECT cluster_id', 'SELECT person_id').replace('GROUP BY cluster_id', 'GROUP BY person_id')} b ON a.person_id = b.person_id WHERE {_DIST} > 0.8 AND a.person_id IN (SELECT person_id FROM {_OWNED} GROUP BY person_id HAVING count(*) > 1)")
def person_outliers(c):
    return _rounded(V.outliers(_owned(c).select("id", "person_id", "embedding"), "person_id", 0.8))


_EDGES = f"(SELECT a.id AS a, b.id AS b FROM {_UNIT} a JOIN {_UNIT} b ON a.id <> b.id AND {_DIST} <= {EPS})"
_DBSCAN = f"""edges AS MATERIALIZED (SELECT * FROM {_EDGES}), core AS (SELECT a AS id FROM edges GROUP BY a HAVING count(*) + 1 >= 3),
  reach AS (SELECT id AS node, id AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node JOIN core c ON c.id = e.b),
  roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), border AS (SELECT e.a AS node, min(r.root) AS root FROM edges e JOIN roots r ON r.node = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a),
  found AS (SELECT * FROM roots UNION ALL SELECT * FROM border), labels_of AS (SELECT u.id, coalesce(dense_rank() OVER (ORDER BY f.root NULLS LAST) - 1, -1) AS k, f.root FROM {_UNIT} u LEFT JOIN found f ON f.node = u.id)"""


def _labels(c: Catalogue) -> DataFrame:
    return D.dbscan(_faces(c), EPS, 3)


@query(f"WITH RECURSIVE {_DBSCAN} SELECT id, CASE WHEN root IS NULL THEN -1 ELSE k END AS label FROM labels_of")
def dbscan_labels(c):
    return _labels(c)


@query(f"WITH RECURSIVE {_DBSCAN}, m AS (SELECT e.label AS truth, CASE WHEN l.root IS NULL THEN -1 ELSE l.k END AS label FROM labels_of l JOIN embeddings e ON e.vec_id = l.id), cells AS (SELECT truth, label, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS x, (SELECT sum(n) FROM cells) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY truth)) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY label)) AS l) SELECT round((x - t * l / (a * (a - 1) / 2)) / ((t + l) / 2 - t * l / (a * (a - 1) / 2)), 6) AS ari FROM s")
def dbscan_ari(c):
    return V.adjusted_rand(_labels(c).join(c.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("truth")), "id"))


# Routing

_GROUPS = f"(SELECT file_id, trim(group_name) AS group_name, count(DISTINCT person_id) AS n, count(DISTINCT nullif(trim(name), '')) AS names FROM {_PAIRS} JOIN persons ON persons.id = person_id GROUP BY 1, 2)"
_MATCH = f"(SELECT g.file_id, o.id AS folder_id, o.sort_order, o.name FROM {_GROUPS} g JOIN folders o ON o.group_name = g.group_name WHERE o.kind = 'only_one' AND n = 1 OR o.kind = 'multiple' AND names >= 2 OR o.kind = 'contains')"
_TARGET = f"(SELECT r.id, r.path, CASE WHEN tab = 'faces' THEN coalesce(m.name, CASE WHEN bound THEN 'People' END, '_faces') WHEN tab = 'animals' THEN 'Animals' WHEN tab = 'quarantine' THEN NULL ELSE '_' || tab END AS target FROM (SELECT *, {_V3} AS tab FROM {_ROWS}) r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sort_order NULLS LAST, folder_id) AS k FROM {_MATCH}) WHERE k = 1) m ON m.file_id = r.id)"


def _targets(c: Catalogue) -> DataFrame:
    return R.target_folder(_rows(c).select("id", L.tab_routing().alias("tab")), _pairs(c), c.persons, c.folders)


@query(f"SELECT file_id, folder_id, sort_order FROM {_MATCH}")
def rule_matches(c):
    return R.rule_matches(_pairs(c), c.persons, c.folders)


@query(f"SELECT id, target FROM {_TARGET}")
def target_folder(c):
    return _targets(c)


@query(f"SELECT CASE WHEN target IS NULL OR starts_with(target, '_') THEN 'unsorted' ELSE target END AS bucket, count(*) AS n FROM {_TARGET} GROUP BY 1")
def routing_report(c):
    return R.routing_report(_targets(c))


@query(f"SELECT id, path AS src, target || '/' || regexp_replace(name, '\\.[^.]*$', '') || CASE WHEN n > 1 THEN ' (' || (n - 1) || ')' ELSE '' END || regexp_extract(name, '(\\.[^.]*)$', 1) AS dst FROM (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY path) AS n FROM (SELECT *, split_part(path, '/', -1) AS name FROM {_TARGET} WHERE target IS NOT NULL))")
def move_plan(c):
    return R.move_plan(c.files, _targets(c))


# Trips

_DATED = "(SELECT *, try_cast(substr(taken_at, 1, 10) AS DATE) AS day FROM files)"
_SESSIONS = "(SELECT *, sum(fresh) OVER (PARTITION BY user_id, place ORDER BY day NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) + 1 AS trip FROM (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY user_id, place ORDER BY day NULLS FIRST, event_id), day) > 1 THEN 1 ELSE 0 END AS fresh FROM timeline))"


@query(f"SELECT event_id, user_id, place, CAST(trip AS BIGINT) AS trip FROM {_SESSIONS}")
def trip_sessions(c):
    return T.sessions(c.timeline, 1, ["user_id", "place"]).select("event_id", "user_id", "place", "trip")


@query(f"SELECT user_id, place, CAST(trip AS BIGINT) AS trip, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM {_SESSIONS} GROUP BY user_id, place, trip")
def trip_summaries(c):
    return T.sessions(c.timeline, 1, ["user_id", "place"]).groupBy("user_id", "place", "trip").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


@query("SELECT trip_id, file_id, path, last_run_id FROM trip_files t JOIN files f ON f.id = t.file_id WHERE t.status = 'included'")
def trip_files_included(c):
    return c.trip_files.where("status = 'included'").join(c.files.select(F.col("id").alias("file_id"), "path", "last_run_id"), "file_id").select("trip_id", "file_id", "path", "last_run_id")


@query(f"SELECT t.id AS trip_id, d.id AS file_id FROM trips t JOIN {_DATED} d ON d.day BETWEEN t.start_date - 1 AND t.end_date + 1 WHERE d.id NOT IN (SELECT file_id FROM trip_files WHERE status = 'included')")
def trip_suggestions(c):
    return T.suggestions(c.files, c.trips, c.trip_files)


@query(f"SELECT t.id AS trip_id, d.id AS file_id FROM trips t JOIN {_DATED} d ON d.day BETWEEN t.start_date AND t.end_date JOIN trip_files x ON x.file_id = d.id AND x.trip_id = t.id AND x.status = 'excluded'")
def trip_excluded_in_range(c):
    return T.in_range(c.files, c.trips).join(c.trip_files.where("status = 'excluded'"), ["trip_id", "file_id"]).select("trip_id", "file_id")


@query(f"SELECT day, trip_id, rank, seconds FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seconds, trip_id) AS rank FROM (SELECT d.day, t.id AS trip_id, CAST(CASE WHEN d.day < t.start_date THEN t.start_date - d.day WHEN d.day > coalesce(t.end_date, t.start_date) THEN d.day - coalesce(t.end_date, t.start_date) ELSE 0 END AS BIGINT) * 86400 AS seconds FROM (SELECT DISTINCT day FROM {_DATED} WHERE day IS NOT NULL) d, trips t)) WHERE rank <= 2")
def trip_nearest_by_date(c):
    return T.nearest_trips(T.dated(c.files).where("day IS NOT NULL").select("day").distinct(), c.trips, 2)


@query(f"SELECT trip_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n_files FROM trip_files t JOIN {_DATED} d ON d.id = t.file_id WHERE t.status = 'included' GROUP BY trip_id")
def trip_date_range(c):
    return T.date_ranges(c.files, c.trip_files)


_JOURNEYS = "(SELECT id, CASE id % 4 WHEN 0 THEN CAST(2000 + id % 25 AS VARCHAR) || ' ' || folder WHEN 1 THEN ' ' || CAST(1990 + id % 9 AS VARCHAR) || upper(lang) WHEN 2 THEN 'x' || CAST(2000 + id AS VARCHAR) ELSE upper(folder) END AS name, CASE WHEN id % 7 <> 0 THEN try_cast(substr(taken_at, 1, 10) AS DATE) END AS start_date FROM files)"


@query(f"SELECT id, year, row_number() OVER (ORDER BY year DESC NULLS LAST, start_date DESC NULLS LAST, lower(name), id DESC) AS position FROM (SELECT *, try_cast(nullif(regexp_extract(trim(name), '^([0-9]{{4}})', 1), '') AS INT) AS year FROM {_JOURNEYS})")
def trip_list_order(c):
    name = F.expr("CASE id % 4 WHEN 0 THEN concat(CAST(2000 + id % 25 AS STRING), ' ', folder) WHEN 1 THEN concat(' ', CAST(1990 + id % 9 AS STRING), upper(lang)) WHEN 2 THEN concat('x', CAST(2000 + id AS STRING)) ELSE upper(folder) END AS name")
    return T.listed(c.files.select("id", name, F.expr("CASE WHEN id % 7 <> 0 THEN try_cast(substring(taken_at, 1, 10) AS date) END AS start_date")))


@query(f"SELECT trip_id, coalesce(CAST(day AS VARCHAR), '_no_date') AS bucket, count(*) AS n FROM trip_files t JOIN {_DATED} d ON d.id = t.file_id WHERE t.status = 'included' GROUP BY 1, 2")
def files_by_date(c):
    return T.by_date(c.files, c.trip_files)


# Gold and hygiene

_EXPECTED = "(SELECT path, arg_min(expected, priority) AS expected FROM gold GROUP BY path)"


@query(f"SELECT expected, count(*) AS total, count(*) FILTER (tab <> expected) AS wrong FROM (SELECT path, {_V1} AS tab FROM {_ROWS}) JOIN {_EXPECTED} USING (path) GROUP BY expected")
def gold_misses(c):
    return G.misses(_rows(c).select("path", L.tab_metrics().alias("tab")), c.gold)


@query("SELECT path, count(DISTINCT expected) AS n FROM gold GROUP BY path HAVING count(DISTINCT expected) > 1")
def gold_duplicates(c):
    return G.in_several_lists(c.gold)


@query(f"SELECT r.id, CASE WHEN e.expected IS NOT NULL AND e.expected <> r.tab THEN 1 ELSE 0 END AS sorted_past_gold FROM (SELECT id, path, {_V2} AS tab FROM {_ROWS}) r LEFT JOIN {_EXPECTED} e USING (path)")
def sorted_past_gold(c):
    rows = _rows(c).select("id", "path", L.tab_ui().alias("tab")).join(G.expected_tab(c.gold), "path", "left")
    return rows.select("id", (F.col("expected").isNotNull() & (F.col("expected") != F.col("tab"))).cast("int").alias("sorted_past_gold"))


@query("SELECT id, match_id FROM (SELECT w.id, f.id AS match_id, row_number() OVER (PARTITION BY w.id ORDER BY CASE WHEN f.cluster_id IS NULL THEN 1 ELSE 0 END, abs(w.bbox_x - f.bbox_x) + abs(w.bbox_y - f.bbox_y) + abs(w.bbox_w - f.bbox_w) + abs(w.bbox_h - f.bbox_h), f.id) AS n FROM (SELECT * FROM rects WHERE id % 5 = 1) w JOIN (SELECT * FROM rects WHERE id % 5 <> 1) f ON f.file_id = w.file_id AND abs(w.bbox_x - f.bbox_x) <= 10 AND abs(w.bbox_y - f.bbox_y) <= 10 AND abs(w.bbox_w - f.bbox_w) <= 10 AND abs(w.bbox_h - f.bbox_h) <= 10) WHERE n = 1")
def bbox_band_match(c):
    return G.band_matches(c.rects.where("id % 5 = 1"), c.rects.where("id % 5 <> 1"), 10)


@query("SELECT quarantine_reason, faces_count, count(*) AS n, min(path) AS sample FROM files WHERE auto_quarantine = 1 GROUP BY 1, 2")
def quarantine_histogram(c):
    return c.files.where("auto_quarantine = 1").groupBy("quarantine_reason", "faces_count").agg(F.count("*").alias("n"), F.min("path").alias("sample"))


@query("SELECT count(*) FILTER (m.animals = 1) AS positives, count(*) FILTER (m.animals = 1 AND f.animals_auto = 1) AS found, count(*) FILTER (m.animals <> 1 AND f.animals_auto = 1) AS \"false\" FROM files f JOIN manual_labels m ON m.file_id = f.id")
def label_recall(c):
    return G.recall(c.files.join(c.manual_labels, F.col("id") == F.col("file_id")), F.col("animals") == 1, F.col("animals_auto") == 1)


@query(f"SELECT CASE WHEN n IS NULL THEN '0' WHEN n = 1 THEN '1' ELSE '2+' END AS bucket, count(*) AS n_files FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM {_PAIRS} GROUP BY file_id) b ON b.file_id = f.id GROUP BY 1")
def binding_buckets(c):
    return G.binding_buckets(c.files, _pairs(c))


@query("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, frame_idx % 2 ORDER BY CASE WHEN manual_person_id IS NULL THEN 1 ELSE 0 END, CASE WHEN cluster_id IS NULL THEN 1 ELSE 0 END, id) AS n FROM rects) WHERE n > 1")
def bbox_dup_cleanup(c):
    return G.superfluous_boxes(c.rects.withColumn("half", F.col("frame_idx") % 2), ["file_id", "half"])


@query("SELECT CASE WHEN f.inventory_scope = 'archive' THEN 'archive' WHEN f.media_type = 'video' THEN 'video' WHEN f.id IS NULL THEN 'other' ELSE 'run' END AS bucket, count(*) AS n, count(r.cluster_id) AS clustered, round(count(r.cluster_id) / count(*), 6) AS share FROM rects r LEFT JOIN files f ON f.id = r.file_id GROUP BY 1")
def embedding_coverage(c):
    rows = c.rects.join(c.files.select(F.col("id").alias("f"), "inventory_scope", "media_type"), F.col("file_id") == F.col("f"), "left")
    bucket = F.when(F.col("inventory_scope") == "archive", "archive").when(F.col("media_type") == "video", "video").when(F.col("f").isNull(), "other").otherwise("run")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count("cluster_id").alias("clustered"), F.round(F.count("cluster_id") / F.count("*"), 6).alias("share"))


@query("SELECT count(*) AS n, count(*) FILTER (coalesce(trim(taken_at), '') <> '') AS with_taken_at, count(*) FILTER (coalesce(trim(place_country), '') <> '') AS with_place_country, count(*) FILTER (coalesce(trim(hash_value), '') <> '') AS with_hash_value FROM files")
def metadata_completeness(c):
    return G.completeness(c.files, ["taken_at", "place_country", "hash_value"])


# Scalars


@query("SELECT id, split_part(path, '/', -1) AS base, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '^([a-z]+):', 1) AS scheme, regexp_replace(path, '^(local|disk):', '') AS bare FROM files")
def path_parts(c):
    p = F.col("path")
    return c.files.select("id", X.base_name(p).alias("base"), X.parent(p).alias("parent"), X.scheme(p).alias("scheme"), X.normal_prefix(p).alias("bare"))


@query("SELECT id, CASE WHEN n IS NULL THEN '-' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size_text FROM (SELECT id, CASE WHEN id % 19 = 0 THEN NULL ELSE size * size * 37 END AS n FROM files)")
def human_bytes(c):
    n = F.expr("CASE WHEN id % 19 = 0 THEN NULL ELSE size * size * 37 END")
    return c.files.select("id", X.human_bytes(n).alias("size_text"))


@query("SELECT id, (size // 3600) || ':' || lpad(CAST(size % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(size % 60 AS VARCHAR), 2, '0') AS duration FROM files")
def human_duration(c):
    return c.files.select("id", X.human_duration(F.col("size")).alias("duration"))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN NULL WHEN id % 3 = 1 THEN taken_at || 'T00:00:00Z' ELSE taken_at || 'T10:11:12Z' END AS taken FROM files WHERE taken_at IS NOT NULL")
def date_from_filename(c):
    flat = F.regexp_replace("taken_at", "-", "")
    name = F.when(F.col("id") % 3 == 2, F.concat(F.lit("scan "), flat)).when(F.col("id") % 3 == 1, F.concat(F.lit("WA-"), F.col("taken_at"), F.lit(".jpg"))).otherwise(F.concat(F.lit("IMG_"), flat, F.lit("_101112.jpg")))
    return c.files.where("taken_at IS NOT NULL").select("id", X.name_timestamp(name).alias("taken"))


@query("SELECT id, printf('%.4f,%.4f', (id % 180) / 3.0, -(id % 360) / 7.0) AS place_key FROM files")
def geo_cache_key(c):
    return c.files.select("id", X.place_key((F.col("id") % 180) / F.lit(3.0), -(F.col("id") % 360) / F.lit(7.0)).alias("place_key"))


@query("SELECT id, CAST(CASE WHEN turn = 90 THEN y WHEN turn = 180 THEN 640 - x - w WHEN turn = 270 THEN 640 - y - h ELSE x END AS BIGINT) AS x, CAST(CASE WHEN turn = 90 THEN 480 - x - w WHEN turn = 180 THEN 480 - y - h WHEN turn = 270 THEN x ELSE y END AS BIGINT) AS y, CAST(CASE WHEN turn IN (90, 270) THEN h ELSE w END AS BIGINT) AS w, CAST(CASE WHEN turn IN (90, 270) THEN w ELSE h END AS BIGINT) AS h FROM (SELECT id, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h, id % 4 * 90 AS turn FROM rects)")
def bbox_unrotate(c):
    col = F.col
    return c.rects.select("id", X.unrotated(col("bbox_x"), col("bbox_y"), col("bbox_w"), col("bbox_h"), col("id") % 4 * 90, F.lit(640), F.lit(480)).alias("box")).select("id", "box.*")


@query("SELECT id, round(size * 0.05, 3) AS t1, round(size * 0.5, 3) AS t2, round(least(size * 0.95, size - 0.05), 3) AS t3 FROM files WHERE size >= 10")
def sample_times(c):
    at = X.sample_times(F.col("size").cast("double"))
    return c.files.where("size >= 10").select("id", at.alias("t")).select("id", *[F.element_at("t", k).alias(f"t{k}") for k in (1, 2, 3)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
