"""Catalogue tables derived from the generated test tables.

Each is one SELECT that Spark and the test oracle read alike; ``$sha``, ``$div``
and ``$day`` stand for the few functions that they spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("documents", "embeddings", "labels", "nation", "region", "events")

TABLES = {
    "files": """
        SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'disk:/' ELSE 'local:/' END || source || '/' || CAST(doc_id AS $text) || CASE WHEN doc_id % 5 = 4 THEN '.mp4' ELSE '.jpg' END AS path,
          CASE WHEN doc_id % 89 = 13 THEN NULL WHEN doc_id % 2 = 0 THEN 'archive' ELSE 'source' END AS inventory_scope, source AS folder, lang, n_chars AS size,
          CASE WHEN doc_id % 5 = 4 THEN 'video' ELSE 'image' END AS media_type, CASE WHEN doc_id % 41 = 5 THEN NULL ELSE 'sha256' END AS hash_alg, CASE WHEN doc_id % 41 = 5 THEN NULL ELSE $sha(text) END AS hash_value,
          CASE WHEN doc_id % 50 = 7 THEN 'deleted' WHEN doc_id % 50 = 11 THEN NULL ELSE 'hashed' END AS status, CAST(CASE WHEN doc_id % 6 = 1 THEN 2 ELSE 1 END AS BIGINT) AS last_run_id, CASE WHEN doc_id % 14 = 3 THEN 1 WHEN doc_id % 14 = 5 THEN 2 END AS ignore_archive_dup_run_id,
          doc_id % 11 AS faces_count, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS animals_auto, CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS auto_quarantine,
          CASE doc_id % 3 WHEN 0 THEN 'tiny_face' WHEN 1 THEN 'many_small_faces' ELSE 'screen_like' END AS quarantine_reason,
          CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST($day AS $text) END AS taken_at,
          CASE doc_id % 4 WHEN 0 THEN 'Norway' WHEN 1 THEN 'Peru' WHEN 2 THEN '' ELSE 'Kenya' END AS place_country, CASE doc_id % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'South' ELSE 'East' END AS place_city
        FROM documents""",
    "phashes": """
        SELECT doc_id AS file_id, a.algorithm, substr($sha(lower(text)), 1, 16) AS value
        FROM documents d JOIN (SELECT 'phash' AS algorithm UNION ALL SELECT 'dhash') a ON d.doc_id % 5 <> 4 AND d.doc_id % 29 <> 3 AND NOT (a.algorithm = 'dhash' AND d.doc_id % 4 = 1)""",
    "hidden_similar": "SELECT DISTINCT algorithm, value FROM phashes WHERE file_id % 7 = 2",
    "frame_hashes": """
        SELECT d.doc_id AS file_id, d.doc_id % 7 + 10 AS duration, k.k * 3 AS offset_sec, substr($sha(d.lang || CAST(d.n_chars % 5 + k.k AS $text)), 1, 16) AS value
        FROM documents d JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k ON d.doc_id % 5 = 4 AND NOT (d.doc_id % 3 = 1 AND k.k = 2)""",
    "manual_labels": """
        SELECT doc_id AS file_id, CASE WHEN doc_id % 6 = 0 AND quality = 1 THEN 'faces' WHEN doc_id % 6 = 0 THEN 'no_faces' END AS faces_label,
          CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS people_no_face, CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS animals, toxic AS quarantine FROM labels""",
    "rects": """
        SELECT vec_id AS id, vec_id $div 3 AS file_id, CAST(embedding AS $vector) AS embedding, CASE WHEN vec_id % 7 = 0 THEN CAST(label AS BIGINT) END AS manual_person_id,
          CASE WHEN vec_id % 7 = 0 OR vec_id % 31 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN 100000 + vec_id ELSE vec_id $div 8 END AS cluster_id, CASE WHEN vec_id % 23 = 0 THEN 1 ELSE 0 END AS ignore_flag,
          vec_id % 40 AS bbox_x, vec_id % 30 AS bbox_y, 20 + vec_id % 50 AS bbox_w, 20 + vec_id % 35 AS bbox_h, 0.5 + (vec_id % 50) / 100.0 AS confidence, vec_id % 3 + 1 AS frame_idx FROM embeddings""",
    "clusters": """
        SELECT c.cluster_id AS id, CASE WHEN c.cluster_id >= 100000 OR c.cluster_id % 4 = 3 THEN NULL ELSE CAST(e.label AS BIGINT) END AS person_id, CASE WHEN c.cluster_id % 2 = 0 THEN 'archive' ELSE 'run' END AS scope
        FROM (SELECT cluster_id, min(id) AS first_id FROM rects WHERE cluster_id IS NOT NULL GROUP BY cluster_id) c JOIN embeddings e ON e.vec_id = c.first_id""",
    "persons": "SELECT CAST(n.n_nationkey AS BIGINT) AS id, n.n_name AS name, r.r_name AS group_name, r.r_regionkey AS group_order FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey < 10",
    "file_persons": "SELECT doc_id AS file_id, doc_id % 10 AS person_id FROM labels WHERE doc_id % 8 = 1",
    "file_groups": "SELECT doc_id AS file_id, lang || '/' || source AS group_path, doc_id AS created FROM documents WHERE doc_id % 3 = 0",
    "trips": "SELECT CAST(k AS BIGINT) AS id, CASE WHEN k % 2 = 0 THEN '2024 Trip ' ELSE 'trip ' END || CAST(k AS $text) AS name, $start AS start_date, CASE WHEN k = 5 THEN NULL ELSE $stop END AS end_date FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5)",
    "trip_files": "SELECT 1 + doc_id % 5 AS trip_id, doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'excluded' ELSE 'included' END AS status FROM documents WHERE doc_id % 7 = 0",
    "gold": "SELECT path, CASE WHEN id % 3 = 0 THEN 'faces' WHEN id % 3 = 1 THEN 'no_faces' ELSE 'quarantine' END AS expected, id % 3 AS priority FROM files WHERE id % 9 < 4 UNION ALL SELECT path, 'animals', 9 FROM files WHERE id % 27 = 0",
    "folders": """
        SELECT 1 AS id, 'Animals' AS name, 'animals' AS rule, 'any' AS kind, '' AS group_name, 30 AS sort_order UNION ALL SELECT 2, 'Asia one', 'only_one', 'only_one', 'ASIA', 10 UNION ALL SELECT 3, 'Asia many', 'multiple', 'multiple', 'ASIA', 5
        UNION ALL SELECT 4, 'Europe', 'contains', 'contains', 'EUROPE', 20 UNION ALL SELECT 5, 'America', 'contains', 'contains', 'AMERICA', NULL UNION ALL SELECT 6, 'People', 'any_people', 'any_people', '', 99""",
    "hidden_groups": "SELECT hash_value AS value FROM files WHERE id % 12 = 0 AND hash_value IS NOT NULL GROUP BY hash_value",
    "timeline": "SELECT event_id, user_id, event_type AS place, CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events",
}
_SPARK = {"sha": "sha256", "div": "div", "text": "STRING", "vector": "ARRAY<DOUBLE>", "day": "date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT))", "start": "date_add(DATE'2024-01-01', 12 * (k - 1))", "stop": "date_add(DATE'2024-01-01', 12 * (k - 1) + 6)"}
_ORACLE = {"sha": "sha256", "div": "//", "text": "VARCHAR", "vector": "DOUBLE[]", "day": "CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS DATE)", "start": "CAST(DATE '2024-01-01' + 12 * (k - 1) AS DATE)", "stop": "CAST(DATE '2024-01-01' + 12 * (k - 1) + 6 AS DATE)"}


def _filled(name: str, words: dict[str, str]) -> str:
    text = TABLES[name]
    for k in sorted(words, key=len, reverse=True):
        text = text.replace(f"${k}", words[k])
    return text.replace("sha256(", "sha2(") if words is _SPARK else text


def with_tables(query: str) -> str:
    """``query`` for the oracle, with the tables that it names in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}(\s|[),;]|$)", text):
                add(TABLES[name])
                if name not in need:
                    need.append(name)

    add(query)
    tables = ", ".join(f"{name} AS ({_filled(name, _ORACLE).strip()})" for name in need)
    body = query.strip()
    if not need:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{tables}, {body.removeprefix(head)}"
    return f"WITH {tables} {body}"


class Catalogue:
    """The derived tables of one folder of test data, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._made:
            return self._made[name]
        if name in TABLES:
            text = _filled(name, _SPARK)
            text = text.replace("sha2(text)", "sha2(text, 256)").replace("sha2(lower(text))", "sha2(lower(text), 256)").replace("sha2(d.lang || CAST(d.n_chars % 5 + k.k AS STRING))", "sha2(d.lang || CAST(d.n_chars % 5 + k.k AS STRING), 256)")
            used = {t: getattr(self, t) for t in [*TABLES, *SOURCES] if t != name and any(f" {w} {t}" in " " + text.replace("\n", " ") for w in ("FROM", "JOIN"))}
            for t, frame in used.items():
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
            self._made[name] = self.spark.sql(text, **used)
        elif name in SOURCES:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        return self._made[name]
