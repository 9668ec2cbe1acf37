"""Crawls, trip folders and rule texts on odd and empty tables."""

from pyspark.sql import functions as F

from cairnmark.operators import routing as R
from cairnmark.operators import runs as N
from cairnmark.operators.vectors import numbered


def test_trip_folders(spark):
    files = spark.createDataFrame([(1, "disk:/x/a/b.jpg", None), (2, "disk:/x /c.jpg", "new"), (3, "disk:/xy/c.jpg", "new"), (4, "disk:/x/d.jpg", "deleted"), (5, None, None), (6, "", None), (7, "disk:/x", None)], "id long, path string, status string")
    trips = spark.createDataFrame([(1, " disk:/x// "), (2, "disk:/x/a"), (3, None), (4, "")], "id long, folder string")
    linked = spark.createDataFrame([(2, 1)], "trip_id long, file_id long")
    found = sorted(map(tuple, N.new_trip_files(files, trips, linked).collect()))
    assert found == [(1, 1), (1, 2), (1, 7)]
    assert N.new_trip_files(files.where("false"), trips, linked).count() == 0


def test_scope_without_status_or_scope(spark):
    files = spark.createDataFrame([(1, "r/a", "video", None, None, "new", None, None), (2, "r/a", "image", "video/x", None, None, None, None), (3, "q", None, None, 2, "new", "source", 1)], "id int, path string, media_type string, mime_type string, faces_run_id int, status string, inventory_scope string, last_run_id int")
    listed = lambda c: [r.id for r in files.where(c).orderBy("id").collect()]
    assert listed(N.listed_in_run(2, "r")) == [1, 3]
    assert listed(N.listed_in_run(2, "r", 1)) == listed(N.counted_in_run(9, None, 1)) == [3]
    assert listed(~N.listed_in_run(2, "r")) == [2]


def test_no_runs_and_no_snapshots(spark):
    runs = spark.createDataFrame([(1, "local_sort", "running", None), (2, "local_sort", None, 1), (3, "local_sort", "failed", 1)], "id long, kind string, status string, face_run_id long")
    faces = spark.createDataFrame([], "id long, total_files long, processed_files long")
    kept = spark.createDataFrame([], "run_id long, cats_total long, cats_mism long, faces_total long, faces_mism long, no_faces_total long, no_faces_mism long, step2_total long, step2_processed long")
    seen = lambda *a: [(r.id, r.total, r.source) for r in N.run_figures(runs, faces, kept, *a).orderBy(F.desc("id")).collect()]
    assert seen() == [(1, None, "pending")]
    assert seen(2, True) == [(3, None, "unavailable"), (2, None, "unavailable")]


def test_numbers_over_many_ranges(spark):
    keys = spark.range(0, 3000, 7).select((F.col("id") * 7919 % 3001).alias("root"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.root: r.number for r in numbered(keys, "root", lambda df: df).collect()}
        assert keys.repartitionByRange("root").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {k: n for n, k in enumerate(sorted(r.root for r in keys.collect()))}


def test_old_rules_and_rule_texts_part_by_part(spark):
    rules = [(1, "only_one_from_group: a : 5"), (2, "only_one_from_group:a:5:6"), (3, "only_one_from_group::5"), (4, "contains_group: a : 5 "), (5, "multiple_from_group_id:7:8"), (6, "ONLY_ONE_FROM_GROUP_ID : 07 : 5"), (7, "Animals"), (8, "contains_group:"), (9, "only_one_from_group_id:x"), (10, "only_one_from_group:7:x")]
    got = {r.id: (r.kind, r.group_id, r.group_name, r.person_id) for r in N.parsed_rules(spark.createDataFrame(rules, "id int, rule string")).collect()}
    assert got == {1: ("only_one", None, "a", 5), 4: ("contains", None, "a : 5", None), 6: ("only_one", 7, None, 5)}
    old = [(1, "только:[a, b];ВМЕСТЕ:[c]"), (2, "только:a"), (3, "содержит:[[x], y]"), (4, ":[a]"), (5, "только:]["), (6, None)]
    got = {(r.id, r.position): (r.kind, r.names) for r in N.old_rules(spark.createDataFrame(old, "id int, rule string")).collect()}
    assert got == {(1, 0): ("только", ["a", "b"]), (1, 1): ("вместе", ["c"]), (3, 0): ("содержит", ["[x]", "y"])}


def test_names_count_once_and_in_one_group(spark):
    persons = spark.createDataFrame([(1, "Ann", "G", 1), (2, " Ann", "G ", 1), (3, "Bob", "G", 1), (4, "Ann", "H", 2), (5, " ", "H", 2), (6, "Cid", "H", 2)], "id long, name string, group_name string, group_id long")
    pairs = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 3), (12, 1), (12, 4), (12, 6), (13, 5), (13, 6), (14, 4), (14, 6), (14, 6)], "file_id long, person_id long")
    got = {(r.file_id, r.group_name): (r.n, r.names) for r in R.group_counts(pairs, persons).collect()}
    assert got == {(10, "G"): (2, 1), (11, "G"): (2, 2), (12, "G"): (1, 1), (12, "H"): (2, 1), (13, "H"): (2, 1), (14, "H"): (2, 2)}
    rules = spark.createDataFrame([(1, "multiple", None, "G", None), (2, "multiple", 1, None, None), (3, "multiple", None, "H", None)], "id long, kind string, group_id long, group_name string, person_id long")
    assert {(r.file_id, r.folder_id) for r in N.rule_files(pairs, persons, rules).collect()} == {(11, 1), (10, 2), (11, 2), (14, 3)}
