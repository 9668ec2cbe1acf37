"""Queries over cluster upkeep, automatic decisions and names, with their SQL; they register with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnmark.operators import assignment as A
from cairnmark.operators import upkeep as U
from cairnmark.operators import vectors as V
from cairnmark.plans.queries import _CENTRE, _DIST, _OWNED, _faces, _owned, _rounded, query, unexpressed

_OLD = "(SELECT r.id, r.cluster_id, c.person_id, CASE WHEN c.id % 3 = 0 THEN 'manual' WHEN c.id % 3 = 1 THEN 'DBSCAN' END AS method FROM rects r JOIN clusters c ON c.id = r.cluster_id)"


@query(f"SELECT r.id, CAST(coalesce(o.cluster_id, CASE WHEN r.id % 6 <> 0 THEN 500000 + r.id % 6 END) AS BIGINT) AS cluster_id FROM rects r LEFT JOIN (SELECT * FROM {_OLD} WHERE person_id IS NOT NULL OR method = 'manual') o ON o.id = r.id")
def persisted_clusters(c):
    method = F.expr("CASE WHEN id % 3 = 0 THEN 'manual' WHEN id % 3 = 1 THEN 'DBSCAN' END").alias("method")
    old = c.rects.select("id", "cluster_id").join(c.clusters.select(F.col("id").alias("cluster_id"), "person_id", method), "cluster_id")
    labels = c.rects.select("id", F.expr("CASE WHEN id % 6 = 0 THEN -1 ELSE id % 6 END AS label"))
    return U.persisted(labels, old, 500000)


_MANUAL = "(SELECT u.id, u.manual_person_id AS person_id, u.u FROM (SELECT *, [x / sqrt(list_dot_product(embedding, embedding)) for x in embedding] AS u FROM rects WHERE ignore_flag = 0) u WHERE u.manual_person_id IS NOT NULL)"
_ARCHIVED = f"(SELECT o.* FROM {_OWNED} o JOIN clusters k ON k.id = o.cluster_id WHERE k.scope = 'archive')"
_MEAN = f"(SELECT person_id, cluster_id, [x / sqrt(list_dot_product(m, m)) for x in m] AS u FROM (SELECT person_id, cluster_id, list(x ORDER BY i) AS m FROM (SELECT person_id, cluster_id, i, avg(u[i]) AS x FROM (SELECT person_id, cluster_id, u, unnest(range(1, 65)) AS i FROM {_ARCHIVED}) GROUP BY 1, 2, 3) GROUP BY 1, 2))"


def _manual_faces(c):
    return _faces(c).where("manual_person_id IS NOT NULL").select("id", F.col("manual_person_id").alias("person_id"), "embedding")


def _archived(c):
    return _owned(c).join(c.clusters.where("scope = 'archive'").select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select("person_id", "cluster_id", "embedding")


@query(
    f"SELECT m.id, coalesce(n.cluster_id, -m.id) AS cluster_id, CASE WHEN n.cluster_id IS NULL THEN 1 ELSE 0 END AS is_new FROM {_MANUAL} m LEFT JOIN (SELECT id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster_id) AS k FROM "
    f"(SELECT a.id, b.cluster_id, {_DIST} AS distance FROM {_MANUAL} a JOIN {_MEAN} b ON a.person_id = b.person_id AND {_DIST} <= 0.5)) WHERE k = 1) n ON n.id = m.id"
)
def person_cluster_or_new(c):
    return A.nearest_or_new(_manual_faces(c), _archived(c), 0.5)


@unexpressed
def manual_faces_in_order(c):
    waiting = V.unit(A.waiting(c.rects, c.files)).select("id", F.col("manual_person_id").alias("person_id"), "embedding")
    return A.in_order(waiting, _archived(c), 0.5)


_RUNS_OF = "CASE WHEN id % 4 <> 3 THEN 1 + id % 3 END"


@query(f"SELECT r.id AS face_id, r.manual_person_id AS person_id, CASE WHEN f.inventory_scope = 'archive' THEN 'archive' END AS archive_scope, CASE WHEN f.inventory_scope = 'archive' THEN NULL ELSE coalesce(CASE WHEN r.id % 5 < 2 THEN r.id % 9 END, f.faces_run_id) END AS run_id FROM rects r LEFT JOIN (SELECT *, {_RUNS_OF} AS faces_run_id FROM files) f ON f.id = r.file_id WHERE r.manual_person_id IS NOT NULL AND r.embedding IS NOT NULL AND (f.inventory_scope = 'archive' OR coalesce(CASE WHEN r.id % 5 < 2 THEN r.id % 9 END, f.faces_run_id) IS NOT NULL)")
def anchor_clusters(c):
    faces = c.rects.where("manual_person_id IS NOT NULL").select("id", "file_id", F.col("manual_person_id").alias("person_id"), F.expr("CASE WHEN id % 5 < 2 THEN id % 9 END AS run_id"), "embedding")
    return A.anchors(faces, c.files.withColumn("faces_run_id", F.expr(_RUNS_OF)))


_MOVES = "(SELECT id AS source, id + 1 AS target FROM clusters WHERE id % 5 = 3 AND id + 1 IN (SELECT id FROM clusters))"


@query(f"SELECT c.id, coalesce(c.person_id, h.heir) AS person_id FROM clusters c LEFT JOIN (SELECT target, min(person_id) AS heir FROM {_MOVES} m JOIN clusters s ON s.id = m.source GROUP BY target) h ON h.target = c.id WHERE c.id NOT IN (SELECT source FROM {_MOVES})")
def merged_cluster_owners(c):
    clusters = c.clusters.select("id", "person_id")
    there = clusters.select(F.col("id").alias("target"))
    moves = clusters.where("id % 5 = 3").select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).join(there, "target", "left_semi").select("source", "target")
    return U.merged(clusters, moves)


_EDITS = "(SELECT id, CASE id % 9 WHEN 1 THEN 'move' WHEN 4 THEN 'remove' ELSE 'clear' END AS action, CAST(7 AS BIGINT) AS cluster_id FROM rects WHERE id % 9 IN (1, 4, 7))"


@query(f"SELECT r.id, CASE WHEN e.action = 'move' THEN e.cluster_id WHEN e.action IN ('remove', 'clear') THEN NULL ELSE r.cluster_id END AS cluster_id FROM rects r LEFT JOIN {_EDITS} e ON e.id = r.id")
def edited_memberships(c):
    edits = c.rects.where("id % 9 IN (1, 4, 7)").select("id", F.expr("CASE id % 9 WHEN 1 THEN 'move' WHEN 4 THEN 'remove' ELSE 'clear' END AS action"), F.lit(7).cast("long").alias("cluster_id"))
    return U.edited(c.rects.select("id", "cluster_id"), edits)


@query(f"SELECT id, cluster_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance DESC, id) AS n FROM (SELECT a.id, a.cluster_id, {_DIST} AS distance FROM {_OWNED} a JOIN {_CENTRE} b ON a.cluster_id = b.cluster_id WHERE a.cluster_id IN (SELECT cluster_id FROM {_OWNED} GROUP BY cluster_id HAVING count(*) > 1))) WHERE n <= 2")
def farthest_members(c):
    members = _owned(c).select("id", "cluster_id", "embedding")
    return _rounded(U.farthest(V.outliers(members, "cluster_id", -1.0), 2))


_SIZES = "(SELECT id AS file_id, CASE WHEN id % 7 = 0 THEN 0 ELSE 400 + 100 * (id % 40) END AS width, 300 + 100 * (id % 30) AS height FROM files)"


@query(f"SELECT b.file_id, 'tiny_face' AS reason FROM (SELECT file_id, max(greatest(bbox_w, bbox_h)) AS side, max(bbox_w * bbox_h) AS area FROM rects GROUP BY file_id) b LEFT JOIN {_SIZES} s ON s.file_id = b.file_id WHERE side <= 32 AND CASE WHEN width > 0 AND height > 0 THEN area / CAST(width * height AS DOUBLE) ELSE 0 END <= 0.0012")
def tiny_face_quarantine(c):
    sizes = c.files.select(F.col("id").alias("file_id"), F.expr("CASE WHEN id % 7 = 0 THEN 0 ELSE 400 + 100 * (id % 40) END AS width"), F.expr("300 + 100 * (id % 30) AS height"))
    return U.tiny_faces(c.rects, sizes)


@query("SELECT id, CASE WHEN faces_count <= 2 AND id % 3 = 0 AND id % 4 <> 0 THEN 0 ELSE faces_count END AS faces FROM files")
def faces_without_cats(c):
    seen = c.files.withColumn("has_cat", F.expr("id % 3 = 0")).withColumn("has_person", F.expr("id % 4 = 0"))
    return seen.select("id", U.faces_after_cats().alias("faces"))


@query("SELECT id, path FROM files WHERE contains(lower(path), '/src1') OR place_country = 'Peru' ORDER BY id DESC LIMIT 20 OFFSET 20")
def searched_page(c):
    return U.searched(c.files.withColumn("country", F.when(F.col("place_country") == "Peru", "at /src1")), "/SRC1", ["path", "country"], 2, 20).select("id", "path")


@query("SELECT file_id AS cluster_id, person_id, faces, count(*) OVER (PARTITION BY faces) AS of_size, avg(faces) OVER (PARTITION BY person_id) AS person_mean FROM (SELECT c.id AS file_id, c.person_id, coalesce(n, 0) AS faces FROM clusters c LEFT JOIN (SELECT cluster_id, count(*) AS n FROM rects WHERE ignore_flag = 0 AND cluster_id IS NOT NULL GROUP BY cluster_id) s ON s.cluster_id = c.id WHERE c.scope = 'archive' AND c.person_id IS NOT NULL)")
def archive_cluster_sizes(c):
    sizes = c.rects.where("ignore_flag = 0 AND cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n"))
    own = c.clusters.where("scope = 'archive' AND person_id IS NOT NULL").select(F.col("id").alias("cluster_id"), "person_id").join(sizes, "cluster_id", "left").withColumn("faces", F.coalesce("n", F.lit(0)))
    by_size, by_person = own.groupBy("faces").agg(F.count("*").alias("of_size")), own.groupBy("person_id").agg(F.avg("faces").alias("person_mean"))
    return own.join(by_size, "faces").join(by_person, "person_id").select("cluster_id", "person_id", "faces", "of_size", "person_mean")


_PATHS = "(SELECT id, CASE id % 5 WHEN 0 THEN path WHEN 1 THEN 'disk:/Фото/' || folder || '/' || CAST(id AS VARCHAR) || '.jpg' WHEN 2 THEN 'local:/alone.jpg' WHEN 3 THEN 'disk:/a//' || folder ELSE 'local:/' || folder || '/x/' || lang END AS p FROM files)"


@query(f"""SELECT id, CASE WHEN len(parts) >= 2 THEN CASE WHEN parts[1] = 'Фото' THEN parts[2] ELSE parts[len(parts) - 1] END END AS folder_name,
    CASE WHEN starts_with(p, 'disk:/') AND coalesce(split_part(p, '/', 3), '') <> '' THEN split_part(p, '/', 3) ELSE '—' END AS short_folder,
    CASE WHEN starts_with(p, 'disk:/Фото/') THEN '…/' || substr(p, 12) ELSE p END AS short_path FROM (SELECT id, p, string_split(replace(replace(p, 'disk:/', ''), 'local:/', ''), '/') AS parts FROM {_PATHS})""")
def short_names(c):
    p = F.expr("CASE id % 5 WHEN 0 THEN path WHEN 1 THEN concat('disk:/Фото/', folder, '/', CAST(id AS STRING), '.jpg') WHEN 2 THEN 'local:/alone.jpg' WHEN 3 THEN concat('disk:/a//', folder) ELSE concat('local:/', folder, '/x/', lang) END")
    rows = c.files.select("id", p.alias("p"))
    return rows.select("id", U.folder_name(F.col("p")).alias("folder_name"), U.short_folder(F.col("p")).alias("short_folder"), U.short_path(F.col("p")).alias("short_path"))


@query("SELECT last_run_id AS run, max(id) AS newest, count(*) AS n FROM files WHERE last_run_id IS NOT NULL GROUP BY last_run_id ORDER BY last_run_id DESC LIMIT 50")
def latest_runs(c):
    return c.files.where("last_run_id IS NOT NULL").groupBy(F.col("last_run_id").alias("run")).agg(F.max("id").alias("newest"), F.count("*").alias("n")).orderBy(F.desc("run")).limit(50)
