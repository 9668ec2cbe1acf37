"""Queries over runs, crawls, trip folders and rule texts, with their SQL; they register with those of ``queries``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.functions import text as X
from cairnmark.operators import crawl as W
from cairnmark.operators import keyed as K
from cairnmark.operators import labels as L
from cairnmark.operators import routing as R
from cairnmark.operators import runs as N
from cairnmark.operators import trips as T
from cairnmark.plans.queries import _MATCH, _PAIRS, _ROWS, _UNSORTED, _V2, _V3, _pairs, query, unexpressed
from cairnmark.sources import exif as E


def _read(c, sql: str) -> DataFrame:
    """A fixture's SELECT, which Spark and the oracle read alike."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    names = set(re.findall(r"(?:FROM|JOIN) (\w+)", sql))
    for n in names:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return c.spark.sql(sql, **{n: getattr(c, n) for n in names})


_SEEN = "SELECT id, path, inventory_scope, last_run_id, status, media_type, CASE WHEN id % 10 = 3 THEN 'video/mp4' END AS mime_type, CASE WHEN id % 4 <> 3 THEN 1 + id % 3 END AS faces_run_id FROM files"
_RUN3 = "(faces_run_id = 3 OR (faces_run_id IS NULL AND (media_type = 'video' OR mime_type LIKE 'video/%') AND starts_with(path, 'local:/src19/')))"
_OWN = "(coalesce(inventory_scope, '') = 'source' AND last_run_id = 1)"


@query(f"SELECT id, CAST(coalesce({_RUN3}, FALSE) AS INT) AS listed, CAST(coalesce({_RUN3}, FALSE) AND {_OWN} AS INT) AS listed_source, CAST({_OWN} AS INT) AS counted_source, CAST(coalesce(faces_run_id = 3, FALSE) AS INT) AS counted_no_root FROM ({_SEEN}) WHERE status <> 'deleted'")
def run_scopes(c):
    root = "local:/src19/"
    flags = {"listed": N.listed_in_run(3, root), "listed_source": N.listed_in_run(3, root, 1), "counted_source": N.counted_in_run(3, root, 1), "counted_no_root": N.counted_in_run(3)}
    return _read(c, _SEEN).where("status <> 'deleted'").select("id", *(f.cast("int").alias(n) for n, f in flags.items()))


_KNOWN = """SELECT id, path, CASE WHEN id % 7 <> 0 THEN concat('r', id) END AS resource_id, inventory_scope, size, CASE WHEN id % 11 <> 1 THEN concat('t', id % 5) END AS modified, status, hash_value,
    CASE WHEN media_type = 'video' THEN id % 90 END AS duration_sec FROM files"""
_FOUND = """SELECT id AS seq, CASE WHEN id % 10 = 4 THEN concat(path, '.moved') ELSE path END AS path, CASE WHEN id % 7 <> 0 THEN concat('r', id) ELSE '' END AS resource_id,
    CASE WHEN id % 8 = 1 THEN size + 1 WHEN id % 43 <> 6 THEN size END AS size, CASE WHEN id % 9 = 2 THEN 'later' WHEN id % 11 <> 1 THEN concat('t', id % 5) END AS modified
  FROM files WHERE id % 6 <> 5 AND id % 2 = 0 UNION ALL SELECT id + 1000000000, concat(path, '.new'), concat('n', id), size, 'now' FROM files WHERE id % 31 = 0"""


@query(f"""WITH k AS ({_KNOWN}), s AS ({_FOUND}), r AS (SELECT s.seq, k.id FROM s JOIN k ON k.resource_id = s.resource_id), m AS (SELECT * FROM r UNION ALL SELECT s.seq, k.id FROM s JOIN k ON k.path = s.path WHERE s.seq NOT IN (SELECT seq FROM r)),
    j AS (SELECT k.*, s.path AS now, s.size AS new_size, s.modified AS new_modified, s.size IS NOT DISTINCT FROM k.size AND s.modified IS NOT DISTINCT FROM k.modified AS same FROM k LEFT JOIN m ON m.id = k.id LEFT JOIN s ON s.seq = m.seq)
  SELECT id, coalesce(now, path) AS path, resource_id, CASE WHEN now IS NULL THEN inventory_scope ELSE 'archive' END AS inventory_scope, CASE WHEN now IS NULL THEN size ELSE new_size END AS size, CASE WHEN now IS NULL THEN modified ELSE new_modified END AS modified,
    CASE WHEN now IS NULL THEN CASE WHEN starts_with(path, 'disk:/') AND status <> 'deleted' THEN 'deleted' ELSE status END WHEN NOT same THEN 'new' WHEN coalesce(status, 'new') <> 'deleted' THEN coalesce(status, 'new') WHEN hash_value IS NULL THEN 'new' ELSE 'hashed' END AS status,
    CASE WHEN now IS NULL OR same THEN hash_value END AS hash_value, CASE WHEN now IS NULL OR same THEN duration_sec END AS duration_sec FROM j
  UNION ALL SELECT NULL, path, nullif(resource_id, ''), 'archive', size, modified, 'new', NULL, NULL FROM s WHERE seq NOT IN (SELECT seq FROM m)""")
def catalogue_after_crawl(c):
    return W.reconciled(_read(c, _KNOWN), _read(c, _FOUND), "disk:/")


_MOVED = """SELECT f.id AS seq, CASE WHEN f.id % 6 = 2 AND o.path IS NOT NULL THEN o.path WHEN f.id % 30 = 4 THEN concat(f.path, '.moved') ELSE f.path END AS path, CASE WHEN f.id % 14 = 3 THEN concat('r', f.id + 1) WHEN f.id % 9 <> 0 THEN concat('r', f.id) END AS resource_id,
    CASE WHEN f.id % 8 <> 1 THEN f.size END AS size, CASE WHEN f.id % 11 <> 1 THEN concat('t', f.id % 5) END AS modified FROM files f LEFT JOIN files o ON o.id = f.id + 1 WHERE f.id % 10 <> 5"""


@unexpressed
def catalogue_after_moves(c):
    return W.reconciled(_read(c, _KNOWN), _read(c, _MOVED), "disk:/")


_HOMES = "SELECT id, CASE id WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'disk:/src4/' ELSE concat(' disk:/src', 2 * id, '/') END AS folder FROM trips"
_LISTING = "SELECT DISTINCT concat(' ', folder) AS name, concat('disk:/', folder) AS path, CASE WHEN folder = 'src6' THEN 'file' ELSE 'dir' END AS type FROM files"
_SPACED = "SELECT id, CASE WHEN id % 9 = 4 THEN replace(path, '/src4/', '/src4 /') WHEN id % 50 = 2 THEN 'disk:/src2' ELSE path END AS path, status FROM files"


@query(f"SELECT trim(name) AS name, path AS folder FROM ({_LISTING}) WHERE type = 'dir' AND path NOT IN ('disk:/src2', 'disk:/src4')")
def trips_of_folders(c):
    return N.new_trips(_read(c, _LISTING), _read(c, _HOMES))


@query(f"SELECT t.id AS trip_id, f.id AS file_id FROM (SELECT id, rtrim(trim(folder), '/') AS folder FROM ({_HOMES})) t JOIN ({_SPACED}) f ON t.folder <> '' AND (f.path = t.folder OR starts_with(f.path, t.folder || '/') OR starts_with(f.path, t.folder || ' /')) LEFT JOIN trip_files x ON x.trip_id = t.id AND x.file_id = f.id WHERE x.file_id IS NULL AND coalesce(f.status, '') <> 'deleted'")
def files_of_trip_folders(c):
    return N.new_trip_files(_read(c, _SPACED), _read(c, _HOMES), c.trip_files)


_RULES = [" Only_One_From_Group : ASIA : 8 ", "only_one_from_group_id:2", "multiple_from_group_id: 1", "contains_group:EUROPE ", "animals", " any_people", "only_one_from_group:A:B", "", "contains_group_id:x", None, "MULTIPLE_FROM_GROUP:ASIA", "contains_group : a:b", "only_one_from_group_id:0:5", "multiple_from_group:AMERICA"]


def _texts(c, rules: list) -> DataFrame:
    return c.spark.createDataFrame(list(enumerate(rules, 1)), "id int, rule string")


#: A rule for every file, in every form, well and badly made.
_WRITTEN = """SELECT id, CASE id % 14 WHEN 0 THEN concat(' Only_One_From_Group : ', folder, ' : ', id, ' ') WHEN 1 THEN concat('only_one_from_group_id:', id % 40) WHEN 2 THEN concat('multiple_from_group_id: ', id % 40) WHEN 3 THEN concat('contains_group:', folder, ' ') WHEN 4 THEN 'animals'
    WHEN 5 THEN ' any_people' WHEN 6 THEN concat('only_one_from_group:', folder, ':', lang) WHEN 7 THEN '' WHEN 8 THEN concat('contains_group_id:', folder) WHEN 9 THEN NULL WHEN 10 THEN concat('MULTIPLE_FROM_GROUP:', upper(folder)) WHEN 11 THEN concat('contains_group : ', lang, ':', folder)
    WHEN 12 THEN concat('only_one_from_group_id:', id % 40, ':', id) ELSE concat('contains group:', folder) END AS rule FROM files"""


@query("""SELECT id, CASE WHEN id % 14 IN (0, 1, 12) THEN 'only_one' WHEN id % 14 IN (2, 10) THEN 'multiple' WHEN id % 14 IN (3, 11) THEN 'contains' WHEN id % 14 = 4 THEN 'animals' ELSE 'any_people' END AS kind, CASE WHEN id % 14 IN (1, 2, 12) THEN id % 40 END AS group_id,
    CASE id % 14 WHEN 0 THEN folder WHEN 3 THEN folder WHEN 10 THEN upper(folder) WHEN 11 THEN lang || ':' || folder END AS group_name, CASE WHEN id % 14 IN (0, 12) THEN id END AS person_id FROM files WHERE id % 14 IN (0, 1, 2, 3, 4, 5, 10, 11, 12)""")
def rules_from_text(c):
    return N.parsed_rules(_read(c, _WRITTEN))


_OLD = """SELECT id, CASE id % 6 WHEN 0 THEN concat('только:[', folder, ']; Вместе : [', lang, ', , ', folder, ']') WHEN 1 THEN 'содержит:[]' WHEN 2 THEN concat('contains:[', folder, ']') WHEN 3 THEN NULL
    WHEN 4 THEN concat('x;содержит:[ ', folder, ' ];') ELSE concat('СОДЕРЖИТ:[', lang, ']x;только:', folder) END AS rule FROM files"""


@query("SELECT id, 0 AS position, 'только' AS kind, folder AS names FROM files WHERE id % 6 = 0 UNION ALL SELECT id, 1, 'вместе', lang || '|' || folder FROM files WHERE id % 6 = 0 UNION ALL SELECT id, 1, 'содержит', folder FROM files WHERE id % 6 = 4")
def older_rules_from_text(c):
    return N.old_rules(_read(c, _OLD)).withColumn("names", F.array_join("names", "|"))


_NAMED = "(SELECT id, group_name, group_order, CASE WHEN id = 3 THEN (SELECT min(name) FROM persons WHERE id = 2) ELSE name END AS name FROM persons)"
_ON = f"(SELECT x.file_id, p.group_name, p.group_order AS g, count(*) AS n, count(DISTINCT p.name) AS names, max(x.person_id) AS who FROM {_PAIRS} x JOIN {_NAMED} p ON p.id = x.person_id GROUP BY ALL)"


@query(f"""SELECT file_id, 1 AS folder_id FROM {_ON} WHERE group_name = 'ASIA' AND n = 1 AND who = 8 UNION ALL SELECT file_id, 2 FROM {_ON} WHERE g = 2 AND n = 1 UNION ALL SELECT file_id, 3 FROM {_ON} WHERE g = 1 AND n > 1
    UNION ALL SELECT file_id, 4 FROM {_ON} WHERE group_name = 'EUROPE' UNION ALL SELECT file_id, 11 FROM {_ON} WHERE group_name = 'ASIA' AND names > 1 UNION ALL SELECT file_id, 13 FROM {_ON} WHERE g = 0 AND n = 1 AND who = 5 UNION ALL SELECT file_id, 14 FROM {_ON} WHERE group_name = 'AMERICA' AND names > 1""")
def files_of_text_rules(c):
    second = F.first(F.when(F.col("id") == 2, F.col("name")), ignorenulls=True)
    one = c.persons.agg(second.alias("second"))
    persons = c.persons.join(F.broadcast(one)).select("id", F.col("group_order").cast("long").alias("group_id"), "group_name", F.when(F.col("id") == 3, F.col("second")).otherwise(F.col("name")).alias("name"))
    return N.rule_files(_pairs(c), persons, N.parsed_rules(_texts(c, _RULES)))


_PRECLEAN = "CASE id % 29 WHEN 3 THEN 'non_media' WHEN 4 THEN 'broken_media' WHEN 5 THEN 'odd' END"
_TOPIC = "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Путешествия' WHEN 2 THEN ' Поездки ' WHEN 3 THEN 'Путешествия/ 2024/ /x' WHEN 4 THEN 'Поездки/aOslo' WHEN 5 THEN '2025 Oslo/day' WHEN 6 THEN '_no_faces/Чеки/дом ' WHEN 7 THEN '/ /' WHEN 8 THEN '_no_faces/' ELSE folder END"
_ROOT = "CASE id % 3 WHEN 0 THEN 'disk:/Root/' WHEN 1 THEN 'local:/data/in' ELSE 'D:/in/' END"
_BASE = "CASE id % 3 WHEN 0 THEN 'disk:/Root/' WHEN 1 THEN 'local:/data/in/' ELSE 'local:D:/in/' END"
_LOCAL = "CASE id % 3 WHEN 0 THEN 'local:disk:/Root/' WHEN 1 THEN 'local:/data/in/' ELSE 'local:D:/in/' END"
_TOPIC_PATH = f"CASE WHEN id % 11 IN (0, 7, 8) THEN NULL WHEN id % 11 IN (1, 2) THEN {_BASE} || 'Путешествия' WHEN id % 11 = 3 THEN {_BASE} || 'Путешествия/2024/x' WHEN id % 11 = 4 THEN {_BASE} || 'Путешествия/Oslo' WHEN id % 11 = 5 THEN {_BASE} || 'Путешествия/2025 Oslo/day' WHEN id % 11 = 6 THEN {_LOCAL} || 'Чеки/дом' ELSE {_LOCAL} || folder END"
_ROUTED = f"""(SELECT r.id, CASE WHEN {_PRECLEAN} = 'non_media' THEN {_BASE} || '_non_media' WHEN {_PRECLEAN} = 'broken_media' THEN {_BASE} || '_broken_media' WHEN {_PRECLEAN} = 'odd' THEN NULL WHEN tab = 'faces' THEN CASE WHEN id % 3 = 0 AND coalesce(m.name, 'People') = 'Europe' THEN 'disk:/Фото/Europe' ELSE {_BASE} || coalesce(m.name, 'People') END
    WHEN tab = 'animals' THEN {_BASE} || 'Animals' WHEN tab = 'people_no_face' THEN {_BASE} || '_people_no_face' WHEN tab = 'no_faces' THEN {_TOPIC_PATH} END AS target
  FROM (SELECT *, {_V3} AS tab FROM {_ROWS}) r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sort_order NULLS LAST, folder_id) AS k FROM {_MATCH}) WHERE k = 1) m ON m.file_id = r.id)"""


def _routed(c, files: DataFrame) -> DataFrame:
    own = lambda df: df.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    pairs = own(_pairs(c))
    rows = L.labelled(files, own(c.manual_labels), pairs)
    rows = rows.select("id", L.tab_routing().alias("tab"), F.expr(_PRECLEAN).alias("set_aside"), F.expr(_TOPIC).alias("group_path"), F.expr(_ROOT).alias("root"))
    folders = c.folders.withColumn("path", F.when(F.col("name") == "Europe", "disk:/Фото/Europe").when(F.col("name") == "Asia one", "local:/x"))
    return R.target_path(rows, pairs, c.persons, folders)


@query(f"SELECT id, target FROM {_ROUTED}")
def target_paths(c):
    return _routed(c, c.files)


@query(f"SELECT id, target FROM {_ROUTED} WHERE id = 6")
def rerouted_file(c):
    return _routed(c, c.files.where("id = 6"))


_LABELS_OF = "(SELECT * FROM (SELECT *, 1 + file_id % 2 AS run FROM manual_labels) WHERE run = 1)"
_RUN_ROWS = f"""(SELECT f.*, m.faces_label, coalesce(m.people_no_face, 0) = 1 AS pnf, coalesce(m.animals, 0) = 1 OR f.animals_auto = 1 AS animal, coalesce(m.quarantine, 0) = 1 AS quar, b.file_id IS NOT NULL AS bound,
    f.auto_quarantine = 1 AND f.faces_count > 0 AS autoq, f.auto_quarantine = 1 AND f.faces_count > 0 AND f.quarantine_reason <> 'many_small_faces' AS autoqx
  FROM (SELECT *, CASE WHEN id % 10 = 3 THEN 'video/mp4' END AS mime_type, CASE WHEN id % 4 <> 3 THEN 1 + id % 3 END AS faces_run_id FROM files) f LEFT JOIN {_LABELS_OF} m ON m.file_id = f.id LEFT JOIN (SELECT DISTINCT file_id FROM {_PAIRS}) b ON b.file_id = f.id WHERE f.status <> 'deleted')"""


def _run_rows(c, scope) -> DataFrame:
    seen = c.files.withColumn("mime_type", F.expr("CASE WHEN id % 10 = 3 THEN 'video/mp4' END")).withColumn("faces_run_id", F.expr("CASE WHEN id % 4 <> 3 THEN 1 + id % 3 END"))
    return L.labelled(seen.where(scope), L.labels_of_run(c.manual_labels.withColumn("run", F.expr("1 + file_id % 2")), 1), _pairs(c))


@query(f"SELECT id, {_V2} AS tab, {_V3} AS routed FROM {_RUN_ROWS} WHERE {_RUN3} AND {_OWN}")
def run_tabs(c):
    return _run_rows(c, N.listed_in_run(3, "local:/src19/", 1)).select("id", L.tab_ui().alias("tab"), L.tab_routing().alias("routed"))


@query(f"SELECT count(*) FILTER (tab = 'faces') AS faces, count(*) FILTER (tab = 'no_faces') AS no_faces, count(*) FILTER (tab = 'animals') AS animals, count(*) FILTER (faces_count >= 8) AS many_faces, count(*) FILTER ({_UNSORTED}) AS unsorted, count(*) FILTER ({_UNSORTED} AND media_type = 'image') AS unsorted_photos, count(*) FILTER ({_UNSORTED} AND media_type = 'video') AS unsorted_videos FROM (SELECT *, {_V2} AS tab FROM {_RUN_ROWS} WHERE {_OWN})")
def run_tab_counts(c):
    return L.tab_counts(_run_rows(c, N.counted_in_run(3, "local:/src19/", 1)))


_RUNS = "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 7 = 3 THEN 'dedup' ELSE 'local_sort' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 5 END AS face_run_id FROM nation"
_FACE_RUNS = "SELECT r_regionkey AS id, 100 + r_regionkey AS total_files, CASE WHEN r_regionkey <> 2 THEN 50 + r_regionkey END AS processed_files FROM region WHERE r_regionkey > 0"
_SNAPS = "SELECT n_nationkey AS run_id, CASE WHEN n_nationkey % 4 <> 2 THEN n_nationkey END AS cats_total, 1 AS cats_mism, n_nationkey * 2 AS faces_total, 2 AS faces_mism, 7 AS no_faces_total, CASE WHEN n_nationkey > 12 THEN 3 END AS no_faces_mism, CASE WHEN n_nationkey % 3 = 1 THEN 900 END AS step2_total, 800 AS step2_processed FROM nation WHERE n_nationkey % 2 = 0"


@query(f"SELECT face_run_id, max(id) AS pipeline_run_id FROM ({_RUNS}) WHERE face_run_id IS NOT NULL GROUP BY face_run_id")
def newest_run_of_faces(c):
    return N.newest_runs(_read(c, _RUNS))


@query(f"""SELECT r.id, status, coalesce(step2_total, total_files) AS total, coalesce(step2_processed, processed_files) AS processed, {", ".join(f"CASE WHEN run_id IS NOT NULL THEN coalesce({k}, 0) END AS {k}" for k in ("cats_total", "cats_mism", "faces_total", "faces_mism", "no_faces_total", "no_faces_mism"))},
    CASE WHEN run_id IS NOT NULL THEN 'snapshot' WHEN status = 'running' THEN 'pending' ELSE 'unavailable' END AS source FROM (SELECT * FROM ({_RUNS}) WHERE kind = 'local_sort' AND status <> 'failed' ORDER BY id DESC LIMIT 12) r LEFT JOIN ({_FACE_RUNS}) f ON f.id = r.face_run_id LEFT JOIN ({_SNAPS}) s ON s.run_id = r.id""")
def run_snapshots(c):
    return N.run_figures(_read(c, _RUNS), _read(c, _FACE_RUNS), _read(c, _SNAPS), 12)


_OPEN = '{"response": {"GeoObjectCollection": {"featureMember": [{"GeoObject": {"metaDataProperty": {"GeocoderMetaData": {"Address": {"Components": ['
_REPLIED = f"""SELECT id, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"response": {{"GeoObjectCollection": {{"featureMember": []}}}}}}' WHEN 4 THEN concat('{_OPEN}', '{{"kind": "street", "name": "', lang, '"}}, {{"name": "y"}}]}}}}}}}}}}]}}}}}}')
    WHEN 5 THEN concat('{_OPEN}', '{{"kind": "Locality", "name": ""}}, {{"kind": "LOCALITY", "name": "', place_city, '"}}]}}}}}}}}}}]}}}}}}') ELSE concat('{_OPEN}', '{{"kind": "country", "name": " ', place_country, ' "}}, {{"kind": "province", "name": "', place_city, '"}}, {{"kind": "locality", "name": "Ica"}}]}}}}}}}}}}]}}}}}}') END AS reply FROM files"""


@query("SELECT id, CASE WHEN id % 7 = 6 THEN nullif(place_country, '') END AS country, CASE WHEN id % 7 IN (5, 6) THEN place_city END AS city FROM files")
def places_of_replies(c):
    return _read(c, _REPLIED).select("id", N.place(F.col("reply")).alias("p")).select("id", "p.country", "p.city")


_STORED = "SELECT id, CASE id % 9 WHEN 1 THEN '[1.0, 2' WHEN 2 THEN 'null' WHEN 3 THEN '[]' WHEN 4 THEN '[1, null]' WHEN 5 THEN '{}' WHEN 6 THEN NULL END AS broken FROM files"


@query("SELECT id, CASE WHEN id % 9 IN (1, 2, 3, 4, 5, 6) THEN NULL ELSE 3 END AS n, CASE WHEN id % 9 IN (0, 7, 8) THEN id / 8.0 END AS first, '{\"eps\":0.4,\"min_samples\":' || (id % 5) || ',\"folder\":\"' || folder || '\"}' AS params, id % 5 AS min_samples FROM files")
def stored_vectors(c):
    vector = F.when(F.expr("id % 9 IN (0, 7, 8)"), X.to_json_array(F.array((F.col("id") / 8.0), F.lit(0.5), F.lit(-1e-7))))
    rows = c.files.select("id", "folder").join(_read(c, _STORED), "id").select("id", "folder", F.coalesce("broken", vector).alias("raw"))
    read = rows.select("id", X.vector_of_json(F.col("raw")).alias("v"), F.to_json(F.struct(F.lit(0.4).alias("eps"), (F.col("id") % 5).alias("min_samples"), "folder")).alias("params"))
    return read.select("id", F.size("v").alias("n"), F.col("v")[0].alias("first"), "params", F.get_json_object("params", "$.min_samples").cast("long").alias("min_samples"))


_SHOTS = "SELECT id, CASE WHEN id % 4 <> 0 THEN (id % 90) + 0.125 END AS lat, CASE WHEN id % 5 <> 0 THEN -(id % 180) - 0.5 END AS lon, CASE WHEN id % 3 <> 0 THEN taken_at END AS taken, CASE WHEN id % 2 = 0 THEN DATE '2019-12-31' END AS changed FROM files"


@query(f"SELECT id, CASE WHEN lat IS NULL OR lon IS NULL THEN 'unknown' ELSE printf('gps_%.4f_%.4f', CAST(lat AS DOUBLE), CAST(lon AS DOUBLE)) END || '/' || coalesce(substr(CAST(coalesce(CAST(taken AS DATE), changed) AS VARCHAR), 1, 4), 'unknown') AS folder FROM ({_SHOTS})")
def place_year_folders(c):
    return _read(c, _SHOTS).select("id", N.place_year(F.col("lat"), F.col("lon"), F.to_date("taken"), F.col("changed")).alias("folder"))


_GROUPED = "SELECT f.id, f.path, coalesce(g.group_path, '') AS group_path FROM files f LEFT JOIN file_groups g ON g.file_id = f.id WHERE f.id % 4 = 0"


@query(f"SELECT id, group_path FROM ({_GROUPED}) ORDER BY CASE WHEN group_path = '' THEN 1 ELSE 0 END, group_path, path, id LIMIT 30 OFFSET 10")
def grouped_files_page(c):
    return _read(c, _GROUPED).orderBy(F.col("group_path") == "", "group_path", "path", "id").offset(10).limit(30).select("id", "group_path")


#: A JPEG's first bytes for every file: orientation, date and place by its id, one in ten cut off in the place.
_BYTE = "lpad(hex({0}), 2, '0')"
_PART = "concat(lpad(hex({0}), 2, '0'), '000000', '{1}000000')"
_PLACE = "concat({0}, {1}, {2})"
_IMAGES = f"""SELECT id, path, media_type, taken_at, unhex(CASE WHEN id % 10 = 3 THEN substring(body, 1, 200) ELSE body END) AS content FROM (SELECT *, concat('FFD8FFE100B4', '457869660000', '49492A0008000000',
    '0300', '1201030001000000', {_BYTE.format("id % 8 + 1")}, '000000', '320102001400000032000000', '258804000100000046000000', '00000000', hex(concat(translate(coalesce(taken_at, '2020-01-01'), '-', ':'), ' 08:09:10')), '00',
    '0400', '0100020002000000', CASE WHEN id % 2 = 0 THEN '4E000000' ELSE '73000000' END, '02000500030000007C000000', '0300020002000000', CASE WHEN id % 3 = 0 THEN '57000000' ELSE '45000000' END, '040005000300000094000000', '00000000',
    {_PLACE.format(_PART.format("id % 90", "01"), _PART.format("id % 60", "01"), _PART.format("id % 250", "64"))}, {_PLACE.format(_PART.format("id % 180", "01"), _PART.format("id % 59", "01"), _PART.format("id % 251", "64"))}) AS body FROM files)"""


@query("""SELECT id, coalesce(CASE WHEN media_type = 'image' THEN coalesce(taken_at, '2020-01-01') || 'T08:09:10Z' END, '2019-01-01') AS taken, id % 8 + 1 AS orientation,
    CASE WHEN id % 10 <> 3 THEN round(CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * (id % 90 + (id % 60) / 60.0 + (id % 250) / 360000.0), 6) END AS lat, CASE WHEN id % 10 <> 3 THEN round(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * (id % 180 + (id % 59) / 60.0 + (id % 251) / 360000.0), 6) END AS lon FROM files""")
def camera_notes(c):
    files = _read(c, _IMAGES)
    found = files.join(E.read_exif(files.select(F.col("id").cast("string").alias("path"), "content")).withColumnRenamed("path", "key"), F.col("id").cast("string") == F.col("key"))
    taken = E.taken_at(F.col("media_type"), F.col("date"), F.lit("x.jpg"), F.lit(None).cast("string"), F.lit("2019-01-01"))
    return found.select("id", taken.alias("taken"), "orientation", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_CACHED = "SELECT concat(place_country, '/', place_city, '/', id % 40) AS key, id AS stamp, CAST(id % 90 AS DOUBLE) AS lat, nullif(trim(place_country), '') AS country, CASE WHEN id % 3 <> 0 THEN concat('{\"id\":', id, '}') END AS raw_json, lang AS source FROM files"
_BEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stamp DESC) AS k FROM ({0}) WHERE {1}) WHERE k = 1)"


@query(f"""SELECT key, coalesce(n.stamp, o.stamp) AS stamp, CASE WHEN n.key IS NULL THEN o.lat ELSE n.lat END AS lat, CASE WHEN n.key IS NULL THEN o.country ELSE n.country END AS country, coalesce(n.raw_json, o.raw_json) AS raw_json, CASE WHEN o.key IS NULL THEN n.source ELSE o.source END AS source
  FROM {_BEST.format(_CACHED.replace('{', '{{').replace('}', '}}'), "stamp % 2 = 0")} o FULL JOIN {_BEST.format(_CACHED.replace('{', '{{').replace('}', '}}'), "stamp % 2 = 1")} n USING (key)""".replace('{{', '{').replace('}}', '}'))
def places_upserted(c):
    rows = _read(c, _CACHED)
    empty = c.spark.createDataFrame([], rows.schema)
    old = K.merged(empty, rows.where("stamp % 2 = 0"), ["key"], {}, ["stamp"]).drop("changed")
    return K.merged(old, rows.where("stamp % 2 = 1"), ["key"], {"raw_json": K.FILLED, "source": K.OLD}, ["stamp"]).drop("changed")


_JOURNEYED = "SELECT id AS line, concat('2024 ', folder, id % 3) AS name, folder AS place_country, date_add(DATE'2024-01-01', CAST(id % 90 AS INT)) AS start_date, date_add(DATE'2024-01-01', CAST(id % 90 + id % 4 AS INT)) AS end_date FROM files WHERE id % 3 = 1"
_JOURNEYED_SQL = _JOURNEYED.replace("date_add(DATE'2024-01-01', CAST(id % 90 AS INT))", "CAST(DATE '2024-01-01' + CAST(id % 90 AS INT) AS DATE)").replace("date_add(DATE'2024-01-01', CAST(id % 90 + id % 4 AS INT))", "CAST(DATE '2024-01-01' + CAST(id % 90 + id % 4 AS INT) AS DATE)")
_TAKEN = "(SELECT DISTINCT try_cast(substr(taken_at, 1, 10) AS DATE) AS day FROM files WHERE id % 5 = 0)"


@query(f"""WITH r AS ({_JOURNEYED_SQL}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY line DESC) AS k FROM r) WHERE k = 1), old AS (SELECT min(id) AS id, ' 2024 ' || folder || '1' AS name, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, lang AS place_country FROM files WHERE id % 7 = 2 GROUP BY folder, lang)
  SELECT o.id, o.name, coalesce(l.start_date, o.start_date) AS start_date, l.end_date, coalesce(l.place_country, o.place_country) AS place_country FROM old o LEFT JOIN last l ON l.name = trim(o.name)
  UNION ALL SELECT NULL, name, start_date, end_date, place_country FROM last WHERE name NOT IN (SELECT trim(name) FROM old) AND name IN (SELECT r.name FROM r JOIN {_TAKEN} d ON d.day BETWEEN r.start_date AND r.end_date)""")
def trips_after_import(c):
    old = c.files.where("id % 7 = 2").groupBy("folder", "lang").agg(F.min("id").alias("id"))
    old = old.select("id", F.concat(F.lit(" 2024 "), "folder", F.lit("1")).alias("name"), *(F.lit(None).cast("date").alias(d) for d in ("start_date", "end_date")), F.col("lang").alias("place_country"))
    return T.imported(old, _read(c, _JOURNEYED), c.files.where("id % 5 = 0"))
