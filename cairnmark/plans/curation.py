"""Queries over lists, snapshots, destinations and cluster upkeep, with their SQL; they register with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnmark.functions import text as X
from cairnmark.operators import curation as C
from cairnmark.operators import inventory as I
from cairnmark.operators import metric as M
from cairnmark.operators import naming as Y
from cairnmark.operators import search as S
from cairnmark.operators import vectors as V
from cairnmark.operators.ordering import places
from cairnmark.plans.queries import _LINKS, _OWNED, _PERSON, _UNIT, EPS, _owned, query


@query("SELECT file_id, value FROM phashes WHERE file_id % 3 <> 0 UNION ALL SELECT file_id, 'new' FROM phashes WHERE file_id % 3 = 0")
def insert_if_absent(c):
    old = c.phashes.where("file_id % 3 <> 0").select("file_id", "value")
    return I.insert_absent(old, c.phashes.select("file_id", F.lit("new").alias("value")), ["file_id"])


_BOXES = "SELECT id, file_id, bbox_x, bbox_y, bbox_w, bbox_h FROM rects"


@query(f"SELECT id FROM (SELECT id, file_id, bbox_x, bbox_y, bbox_w, CASE WHEN id % 8 = 1 THEN bbox_h + 1 ELSE bbox_h END AS bbox_h FROM rects WHERE id % 4 = 1) WHERE (file_id, bbox_x, bbox_y, bbox_w, bbox_h) NOT IN (SELECT (file_id, bbox_x, bbox_y, bbox_w, bbox_h) FROM ({_BOXES}) WHERE id % 3 <> 0)")
def new_detections(c):
    box = ["file_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    old = c.rects.where("id % 3 <> 0").select(*box)
    found = c.rects.where("id % 4 = 1").select("id", *box[:-1], F.expr("CASE WHEN id % 8 = 1 THEN bbox_h + 1 ELSE bbox_h END AS bbox_h"))
    return found.join(old, box, "left_anti").select("id")


@query("SELECT path, min(source) AS source, arg_min(id, source) AS id FROM (SELECT path, 0 AS source, id FROM files WHERE id % 9 < 4 UNION ALL SELECT path, 1, id FROM files WHERE id % 6 < 3) GROUP BY path")
def gold_append(c):
    f = c.files.select("path", "id")
    return C.appended(f.where("id % 9 < 4"), f.where("id % 6 < 3"), "path", "id")


@query("SELECT folder, max(id) AS line, arg_max(path, id) AS path FROM files GROUP BY folder")
def last_line_wins(c):
    return C.last_line(c.files.select("folder", F.col("id").alias("line"), "path"), "folder", "line")


@query("SELECT id, path FROM files WHERE path > 'disk:/src11/5' ORDER BY path, id LIMIT 25")
def keyset_page(c):
    return c.files.where(F.col("path") > "disk:/src11/5").select("id", "path").orderBy("path", "id").limit(25)


@query("SELECT id, path, hash_value FROM files WHERE (folder, media_type) IN (SELECT (folder, media_type) FROM files WHERE id % 97 = 0)")
def tuple_filter(c):
    wanted = c.files.where("id % 97 = 0").select("folder", "media_type").distinct()
    return c.files.join(wanted, ["folder", "media_type"], "left_semi").select("id", "path", "hash_value")


@query("SELECT id, CASE WHEN regexp_matches(CASE WHEN id % 4 = 0 THEN 'disk:/a/_keep/' ELSE 'disk:/a/keep/' END || folder, '/_[^/]*/[^/]*$') THEN 1 ELSE 0 END AS hidden FROM files")
def underscore_folders(c):
    path = F.concat(F.when(F.col("id") % 4 == 0, "disk:/a/_keep/").otherwise("disk:/a/keep/"), "folder")
    return c.files.select("id", X.in_hidden_folder(path).cast("int").alias("hidden"))


_TARGETS = "(SELECT id, CASE WHEN id % 5 <> 0 THEN id % 17 END AS sort_order, lang || '/' || folder AS name, hash_value AS code FROM files)"


@query(f"SELECT id, row_number() OVER (ORDER BY sort_order NULLS LAST, name, code NULLS LAST, id) - 1 AS position FROM {_TARGETS}")
def folder_list_order(c):
    rows = c.files.select("id", F.expr("CASE WHEN id % 5 <> 0 THEN id % 17 END AS sort_order"), F.concat("lang", F.lit("/"), "folder").alias("name"), F.col("hash_value").alias("code"))
    return places(rows, [], [F.asc_nulls_last("sort_order"), "name", F.asc_nulls_last("code"), "id"], "position").select("id", "position")


@query("SELECT id, row_number() OVER (ORDER BY CASE WHEN id = 6 THEN 1 ELSE 0 END, coalesce(group_order, 999), name) AS position FROM persons")
def person_list_order(c):
    order = [(F.col("id") == 6).cast("int"), F.coalesce("group_order", F.lit(999)), "name"]
    return places(c.persons, [], order, "before").select("id", (F.col("before") + 1).alias("position"))


@query("SELECT id FROM files WHERE animals_auto = 1 UNION SELECT file_id FROM manual_labels WHERE animals = 1")
def animal_files(c):
    return c.files.where("animals_auto = 1").select("id").union(c.manual_labels.where("animals = 1").select("file_id")).distinct()


@query("SELECT hash_value FROM files WHERE inventory_scope = 'source' AND hash_value IS NOT NULL EXCEPT SELECT hash_value FROM files WHERE coalesce(inventory_scope, 'archive') = 'archive'")
def hashes_only_in_source(c):
    source = c.files.where("inventory_scope = 'source' AND hash_value IS NOT NULL").select("hash_value").distinct()
    return source.join(c.files.where(I.in_archive(F.col("inventory_scope"))).select("hash_value"), "hash_value", "left_anti")


@query("SELECT hash_value FROM files WHERE inventory_scope = 'source' AND hash_value IS NOT NULL INTERSECT SELECT hash_value FROM files WHERE coalesce(inventory_scope, 'archive') = 'archive'")
def hashes_in_both(c):
    return c.files.where("inventory_scope = 'source' AND hash_value IS NOT NULL").select("hash_value").intersect(c.files.where(I.in_archive(F.col("inventory_scope"))).select("hash_value"))


@query("SELECT f.path, r.bbox_x AS x, r.bbox_y AS y FROM rects r JOIN files f ON f.id = r.file_id WHERE manual_person_id IS NOT NULL UNION SELECT f.path, r.bbox_x, r.bbox_y FROM rects r JOIN files f ON f.id = r.file_id JOIN clusters c ON c.id = r.cluster_id WHERE c.person_id IS NOT NULL")
def gold_rects(c):
    own = c.rects.join(c.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), "manual_person_id", "cluster_id")
    bound = own.join(c.clusters.where("person_id IS NOT NULL").select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    return own.where("manual_person_id IS NOT NULL").select("path", "x", "y").union(bound.select("path", "x", "y")).distinct()


@query("SELECT group_path, max(created) AS created, arg_max(file_id, created) AS file_id FROM file_groups GROUP BY group_path")
def latest_in_group(c):
    return c.file_groups.groupBy("group_path").agg(F.max("created").alias("created"), F.max_by("file_id", "created").alias("file_id"))


_ROOTS = "(SELECT 'local:/' || folder AS root, max(id) AS run_id FROM files WHERE folder <> 'src1' GROUP BY folder UNION ALL SELECT 'local:/src', 9999999 UNION ALL SELECT 'local:', 1)"


@query(f"WITH g AS (SELECT file_id, max(CASE WHEN created % 2 = 0 THEN created % 7 END) AS run_id FROM file_groups GROUP BY file_id HAVING run_id IS NOT NULL) SELECT id, run_id FROM files JOIN g ON g.file_id = id UNION ALL SELECT f.id, max(r.run_id) FROM files f JOIN {_ROOTS} r ON starts_with(f.path, r.root || '/') WHERE starts_with(f.path, 'local:') AND f.id NOT IN (SELECT file_id FROM g) GROUP BY f.id")
def run_for_path(c):
    roots = c.files.where("folder <> 'src1'").groupBy(F.concat(F.lit("local:/"), "folder").alias("root")).agg(F.max("id").alias("run_id")).union(c.spark.createDataFrame([("local:/src", 9999999), ("local:", 1)], "root string, run_id long"))
    return C.newest_under_root(c.files, roots, c.file_groups.select("file_id", F.expr("CASE WHEN created % 2 = 0 THEN created % 7 END AS run_id")))


@query("SELECT file_id, string_agg(CAST(trip_id AS VARCHAR), ',' ORDER BY trip_id) AS trips FROM trip_files WHERE status = 'included' GROUP BY file_id")
def trips_of_files(c):
    ids = F.transform(F.array_sort(F.collect_list("trip_id")), lambda x: x.cast("string"))
    return c.trip_files.where("status = 'included'").groupBy("file_id").agg(F.array_join(ids, ",").alias("trips"))


@query(f"SELECT person, count(*) AS n_faces, count(DISTINCT file_id) AS n_files, count(DISTINCT cluster_id) AS n_clusters FROM {_PERSON} GROUP BY person")
def person_distribution(c):
    live = c.rects.where("ignore_flag = 0").join(c.clusters.select(F.col("id").alias("cluster_id"), "person_id"), "cluster_id", "left")
    return live.groupBy(F.coalesce("manual_person_id", "person_id").alias("person")).agg(F.count("*").alias("n_faces"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("cluster_id").alias("n_clusters"))


@query("SELECT id, CASE WHEN size > 0 THEN greatest(0, least(100, CAST(round(100.0 * faces_count * 700 / size) AS INT))) END AS progress FROM files")
def step_progress(c):
    return c.files.select("id", C.percent(F.col("faces_count") * 700, F.col("size")).alias("progress"))


_NEWCOMERS = "(SELECT id, folder, 'IMG' || (id % 13) || '.' || media_type AS name FROM files WHERE id % 4 <> 0)"
_THERE = "(SELECT DISTINCT folder, 'IMG' || (id % 13) || CASE WHEN id % 8 = 0 THEN '' ELSE ' (' || (id % 5 + 1) || ')' END || '.' || media_type AS name, 'IMG' || (id % 13) || '.' || media_type AS own, CASE WHEN id % 8 = 0 THEN 0 ELSE id % 5 + 1 END AS k FROM files WHERE id % 4 = 0)"


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY id) AS r FROM {_NEWCOMERS}), many AS (SELECT folder, name, count(*) + (SELECT count(*) FROM {_THERE} t WHERE t.folder = n.folder AND t.own = n.name) AS m FROM n GROUP BY folder, name),
    free AS (SELECT folder, name, k, row_number() OVER (PARTITION BY folder, name ORDER BY k) AS r FROM (SELECT folder, name, unnest(range(m)) AS k FROM many) c WHERE NOT EXISTS (SELECT 1 FROM {_THERE} t WHERE t.folder = c.folder AND t.own = c.name AND t.k = c.k))
    SELECT id, CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || ' (' || k || ')' || regexp_extract(name, '(\\.[^.]*)$', 1) END AS unique_name FROM n JOIN free USING (folder, name, r)"""
)
def unique_destinations(c):
    own = F.concat(F.lit("IMG"), (F.col("id") % 13).cast("string"))
    new = c.files.where("id % 4 <> 0").select("id", "folder", F.concat(own, F.lit("."), "media_type").alias("name"))
    number = F.when(F.col("id") % 8 == 0, "").otherwise(F.concat(F.lit(" ("), (F.col("id") % 5 + 1).cast("string"), F.lit(")")))
    there = c.files.where("id % 4 = 0").select("folder", F.concat(own, number, F.lit("."), "media_type").alias("name"))
    return Y.free_names(new, there, ["id"]).select("id", "unique_name")


@query("SELECT id, trim(regexp_replace(lang || '/' || folder || ' <' || id || '> ', '[^\\p{L}\\p{N}\\-_. ]', '_', 'g')) AS segment FROM files")
def safe_segments(c):
    return c.files.select("id", X.safe_segment(F.concat("lang", F.lit("/"), "folder", F.lit(" <"), F.col("id").cast("string"), F.lit("> "))).alias("segment"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(taken_at || 'T08:09:10Z', '2020-01-01') WHEN taken_at IS NOT NULL THEN taken_at || 'T00:00:00Z' ELSE '2020-01-01' END AS taken FROM files")
def taken_at_precedence(c):
    exif = F.when(F.col("id") % 3 == 0, F.concat(F.translate("taken_at", "-", ":"), F.lit(" 08:09:10")))
    return c.files.select("id", F.coalesce(X.exif_timestamp(exif), X.name_timestamp(F.col("taken_at")), F.lit("2020-01-01")).alias("taken"))


@query("SELECT id, round((CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) * (id % 90 + (id % 60) / 60.0 + (id % 59) / 3600.0), 6) AS lat FROM files")
def gps_degrees(c):
    d = F.col("id")
    return c.files.select("id", F.round(X.degrees(d % 90, d % 60, d % 59, F.when(d % 2 == 0, "N").otherwise("s")), 6).alias("lat"))


@query("SELECT id, CAST(taken_at AS DATE) AS day FROM files WHERE taken_at IS NOT NULL")
def repaired_dates(c):
    part = lambda a, n: F.substring("taken_at", a, n)
    day, month, year = part(9, 2), part(6, 2), part(1, 4)
    typed = F.when(F.col("id") % 3 == 0, F.concat(day, F.lit("."), month, year)).when(F.col("id") % 3 == 1, F.concat(day, F.lit(" "), month, F.lit("."), year)).otherwise(F.concat_ws(".", day, month, year))
    return c.files.where("taken_at IS NOT NULL").select("id", X.repaired_date(typed).alias("day"))


@query("SELECT t.id, least(t.start_date, x.first_day) AS start_date, greatest(coalesce(t.end_date, t.start_date), x.last_day) AS end_date FROM trips t JOIN (SELECT trip_id, min(CAST(taken_at AS DATE)) AS first_day, max(CAST(taken_at AS DATE)) AS last_day FROM trip_files JOIN files ON id = file_id GROUP BY trip_id) x ON x.trip_id = t.id")
def expanded_trips(c):
    days = c.trip_files.join(c.files.select(F.col("id").alias("file_id"), F.col("taken_at").cast("date").alias("day")), "file_id").groupBy("trip_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return c.trips.join(days, F.col("id") == F.col("trip_id")).select("id", F.least("start_date", "first_day").alias("start_date"), F.greatest(F.coalesce("end_date", "start_date"), "last_day").alias("end_date"))


@query("SELECT id, CAST(CASE turn WHEN 90 THEN 480 - y - h WHEN 180 THEN 640 - x - w WHEN 270 THEN y ELSE x END AS BIGINT) AS x, CAST(CASE turn WHEN 90 THEN x WHEN 180 THEN 480 - y - h WHEN 270 THEN 640 - x - w ELSE y END AS BIGINT) AS y FROM (SELECT id, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h, id % 4 * 90 AS turn FROM rects)")
def bbox_rotate(c):
    col = F.col
    return c.rects.select("id", X.rotated(col("bbox_x"), col("bbox_y"), col("bbox_w"), col("bbox_h"), col("id") % 4 * 90, F.lit(640), F.lit(480)).alias("b")).select("id", "b.x", "b.y")


@query("SELECT id, CASE WHEN id % 5 <> 0 THEN size + 1 END AS scanned FROM files")
def log_counters(c):
    size = F.col("size")
    log = F.when(F.col("id") % 5 == 0, "nothing yet").otherwise(F.concat(F.lit("scanned="), size.cast("string"), F.lit(" skipped=3 scanned="), (size + 1).cast("string"), F.lit(" done")))
    return c.files.select("id", X.last_counter(log, "scanned").alias("scanned"))


@query("SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS bucket, count(*) AS n, count(*) FILTER (animals_auto = 1) AS animals FROM files GROUP BY 1")
def path_buckets(c):
    return c.files.groupBy(X.bucket(F.col("path"), 2).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("animals_auto") == 1).alias("animals"))


@query(f"SELECT id, coalesce(target, cluster_id) AS cluster_id FROM {_OWNED} LEFT JOIN (SELECT c1 AS source, min(c2) AS target FROM {_LINKS} GROUP BY c1) ON source = cluster_id")
def merged_clusters(c):
    members = _owned(c)
    moves = V.cluster_links(members, 0.8).groupBy(F.col("c1").alias("source")).agg(F.min("c2").alias("target"))
    return C.merged(members, moves)


_PCENTRE = "(SELECT person_id, [x / sqrt(list_dot_product(m, m)) for x in m] AS u FROM (SELECT person_id, list(x ORDER BY i) AS m FROM (SELECT person_id, i, avg(u[i]) AS x FROM (SELECT person_id, u, unnest(range(1, len(u) + 1)) AS i FROM " + _OWNED + ") GROUP BY person_id, i) GROUP BY person_id))"


@query(f"SELECT a.id, a.person_id FROM {_OWNED} a JOIN {_PCENTRE} b ON a.person_id = b.person_id WHERE least(bbox_w, bbox_h) >= 30 AND confidence >= 0.6 AND NOT (1 - list_dot_product(a.u, b.u) > 0.8 AND a.person_id IN (SELECT person_id FROM {_OWNED} GROUP BY person_id HAVING count(*) > 1))")
def ground_truth_snapshot(c):
    members = _owned(c)
    odd = V.outliers(members.select("id", "person_id", "embedding"), "person_id", 0.8).select("id")
    return members.where("least(bbox_w, bbox_h) >= 30 AND confidence >= 0.6").join(odd, "id", "left_anti").select("id", "person_id")


@query("SELECT coalesce(a.id, b.id) AS id, a.v AS before, b.v AS after, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT id, cluster_id AS v FROM rects WHERE id % 5 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE cluster_id END AS v FROM rects WHERE id % 7 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v IS DISTINCT FROM b.v")
def snapshot_differences(c):
    before = c.rects.where("id % 5 <> 0").select("id", F.col("cluster_id").alias("v"))
    after = c.rects.where("id % 7 <> 0").select("id", F.when(F.col("id") % 6 != 0, F.col("cluster_id")).alias("v"))
    return C.differences(before, after, "id", "v")


@query("""SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'faces' WHEN file_id % 4 <> 1 THEN faces_label END AS faces_label, CASE WHEN file_id % 4 < 2 THEN 0 ELSE people_no_face END AS people_no_face,
  CASE WHEN file_id % 4 = 0 THEN 0 WHEN file_id % 4 = 1 THEN 1 ELSE animals END AS animals, CASE WHEN file_id % 4 < 2 THEN 0 ELSE quarantine END AS quarantine FROM manual_labels""")
def exclusive_labels(c):
    chosen = c.manual_labels.where("file_id % 4 < 2").select("file_id", F.when(F.col("file_id") % 4 == 0, "faces").otherwise("animals").alias("choice"))
    return C.exclusive_labels(c.manual_labels, chosen)


@query("SELECT trip_id, first_day, row_number() OVER (ORDER BY first_day NULLS FIRST, trip_id) AS position FROM (SELECT trip_id, min(CAST(taken_at AS DATE)) AS first_day FROM trip_files LEFT JOIN files ON id = file_id GROUP BY trip_id)")
def trip_first_dates(c):
    first = c.trip_files.join(c.files.select(F.col("id").alias("file_id"), F.col("taken_at").cast("date").alias("day")), "file_id", "left").groupBy("trip_id").agg(F.min("day").alias("first_day"))
    return places(first, [], [F.asc_nulls_first("first_day"), "trip_id"], "before").select("trip_id", "first_day", (F.col("before") + 1).alias("position"))


@query(f"SELECT a.id AS face_id, b.id AS other_id FROM {_UNIT} a JOIN {_UNIT} b ON a.id < b.id AND 1 - list_dot_product(a.u, b.u) <= {EPS} WHERE a.file_id <> b.file_id")
def faces_alike_in_other_files(c):
    faces = V.unit(c.rects.where("ignore_flag = 0"))
    return M.close_pairs(faces, None, EPS, unlike="file_id").select(F.col("a").alias("face_id"), F.col("b").alias("other_id"))


@query("WITH items AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM (SELECT DISTINCT path FROM gold)), m AS (SELECT * FROM items WHERE contains(lower(path), '/src1')) SELECT place, path, (SELECT count(*) FROM m) AS total, CAST((SELECT count(*) FROM m) > 40 AS INT) AS more FROM m ORDER BY place LIMIT 20 OFFSET 20")
def gold_search_page(c):
    index = S.Index.of(c.gold.select(F.col("path").alias("entry")).distinct(), ["entry"])
    first = index.page("/SRC1", None, 20).orderBy(F.desc("place")).limit(1).first()
    return index.page(" /Src1", first.entry if first else None, 20).select("place", F.col("entry").alias("path"), "total", F.col("more").cast("int").alias("more"))
