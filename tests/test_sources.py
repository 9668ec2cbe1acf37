"""Readers over small files, and streams held against the same batch query."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairnmark.sources import files, lists
from cairnmark.streaming import timeline


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.JPG": b"\xff\xd8\xff1234", "sub/b.png": b"not a png", "sub/c.mp4": b"video", "skip/d.jpg": b"\xff\xd8\xff", "e.txt": b"text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_scan(spark, folder):
    found = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(folder), ["skip"]).collect()}
    assert set(found) == {"a.JPG", "b.png", "c.mp4", "e.txt"}
    assert [found[x].media_type for x in ("a.JPG", "c.mp4", "e.txt")] == ["image", "video", None]
    assert found["a.JPG"].hash_value == hashlib.sha256(b"\xff\xd8\xff1234").hexdigest()
    assert found["b.png"].broken and not found["a.JPG"].broken and not found["e.txt"].broken


def test_rescan_keeps_known_hashes(spark, folder):
    known = files.scan(spark, str(folder)).withColumn("hash_value", F.when(F.col("path").endswith("a.JPG"), "known").otherwise(F.col("hash_value")))
    known = spark.createDataFrame(known.collect(), known.schema)
    (folder / "sub/c.mp4").write_bytes(b"another video")
    found = {r.path.rsplit("/", 1)[1]: r.hash_value for r in files.rescan(spark, str(folder), known).collect()}
    assert found["a.JPG"] == "known" and found["c.mp4"] == hashlib.sha256(b"another video").hexdigest() and len(found) == 5


def test_listing(spark, tmp_path):
    rows = [{"path": "disk:/a", "size": 1, "sha256": "x", "md5": "y"}, {"path": "disk:/b", "size": 2, "md5": "z"}, {"path": "disk:/c", "size": 99}, {"path": "disk:/d", "size": 3}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    found = [(r.hash_alg, r.hash_value, r.status) for r in files.listing(spark, str(tmp_path / "l.json"), 50).orderBy("path").collect()]
    assert found == [("sha256", "x", "hashed"), ("md5", "z", "hashed"), (None, None, "skipped_large"), (None, None, "new")]


def test_gold(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\ufeffdisk:/a.jpg\n\n  # note\n C:\\x\\b.jpg \n\\\\share\\c.jpg\ndisk:/a.jpg\n", encoding="utf-8")
    assert sorted(r.path for r in lists.read_gold(spark, str(tmp_path / "g.txt")).collect()) == ["disk:/a.jpg", "local:C:\\x\\b.jpg", "local:\\\\share\\c.jpg"]


def test_markup_round_trip(spark, tmp_path):
    (tmp_path / "m.ndjson").write_text('{"path": "a", "n": 1}\nbroken\n{"n": 5}\n{"path": "b", "n": 2}\n{"path": "a", "n": 3}\n')
    found = lists.read_markup(spark, str(tmp_path / "m.ndjson"), "path string, n int")
    assert sorted((r.path, r.n) for r in found.collect()) == [("a", 3), ("b", 2)]
    lists.write_markup(found, str(tmp_path / "out"))
    again = lists.read_markup(spark, str(tmp_path / "out"), "path string, n int")
    assert sorted((r.path, r.n) for r in again.collect()) == [("a", 3), ("b", 2)]


def test_trips(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffTrips;;;\nCountry;;In;Out\nPeru;;01.02.2024;10.02.2024\nKenya;;16.052023;24 04.2023\nNorway;;03.03.2024;\n;;01.01.2020;\nChad;;bad;\n", encoding="utf-8")
    day = datetime.date
    found = [tuple(r) for r in lists.read_trips(spark, str(tmp_path / "t.csv")).orderBy("place_country").collect()]
    assert found == [("Kenya", day(2023, 4, 24), day(2023, 5, 16)), ("Norway", day(2024, 3, 3), None), ("Peru", day(2024, 2, 1), day(2024, 2, 10))]


def test_read_query_refuses_other_statements(spark):
    assert lists.read_query(spark, "SELECT 1 AS x;").first().x == 1
    assert lists.read_query(spark, "SELECT ';' AS a").first().a == ";"
    assert lists.read_query(spark, "WITH x AS (SELECT 7 AS a) SELECT a, (SELECT max(a) FROM x) AS b FROM x").first().b == 7
    spark.range(3).createOrReplaceTempView("guarded")
    assert "guarded" in {r.tableName for r in lists.read_query(spark, "SHOW TABLES").collect()} and lists.read_query(spark, "DESCRIBE guarded").count() == 1
    for text in ("DROP TABLE x", "SELECT 1; SELECT 2", "", " \n", ";", "WITH x AS (SELECT 7 AS a) INSERT INTO guarded SELECT a FROM x", "FROM guarded INSERT INTO t SELECT id INSERT INTO u SELECT id", "EXPLAIN SELECT 1", "SET a = b", "CREATE TABLE y AS SELECT 1", "SELECT TRANSFORM(id) USING 'cat' AS x FROM guarded", "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS x FROM guarded)", "CACHE TABLE guarded"):
        with pytest.raises(ValueError):
            lists.read_query(spark, text)


def streamed(spark, tmp_path, rows, schema, work, name):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    out = work(spark.readStream.schema(schema).parquet(path))
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


T = lambda d, h=0: datetime.datetime(2024, 1, d, h)


def test_visits_end_after_a_gap(spark, tmp_path):
    rows = [(1, "x", T(1)), (1, "x", T(5)), (1, "x", T(20)), (2, "y", T(2)), (9, "z", datetime.datetime(2024, 6, 1))]
    found = streamed(spark, tmp_path, rows, "user_id long, place string, ts timestamp", timeline.visits, "visits")
    assert sorted(found) == [(1, "x", T(1), T(15), 2), (1, "x", T(20), T(30), 1), (2, "y", T(2), T(12), 1)]


def test_arrivals_by_day(spark, tmp_path):
    rows = [("x", T(1, 1), 1.0), ("x", T(1, 23), 2.5), ("x", T(2), 4.0), ("z", T(30), 0.0)]
    found = streamed(spark, tmp_path, rows, "place string, ts timestamp, value double", timeline.arrivals, "arrivals")
    assert sorted(found) == [("x", T(1), 2, 3.5), ("x", T(2), 1, 4.0)]


def test_first_seen(spark, tmp_path):
    rows = [("h", T(1)), ("h", T(2)), ("i", T(1))]
    assert sorted(r[0] for r in streamed(spark, tmp_path, rows, "hash_value string, ts timestamp", timeline.first_seen, "seen")) == ["h", "i"]


def test_unprocessed(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert [r.path for r in timeline.unprocessed(rows, rows.where("path = 'c'"), "a").collect()] == ["b"]


def test_broken_images_by_their_first_bytes(spark, tmp_path):
    heads = {"a.jpg": b"\xff\xd8\x00\x01", "b.jpg": b"\xff\xd9", "c.tif": b"MM\x00*rest", "d.tiff": b"II*\x00rest", "e.tif": b"XX*\x00", "f.webp": b"RIFF\x01\x02\x03\x04WEBPVP8 ", "g.webp": b"RIFF\x01\x02\x03\x04WAVEfmt ", "h.png": b"\x89PNG\r\n\x1a\n", "i.png": b"\x89PNG", "j.bmp": b"BM12", "k.heic": b"anything"}
    for name, head in heads.items():
        (tmp_path / name).write_bytes(head)
    found = {r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path)).where("broken").collect()}
    assert found == {"b.jpg", "e.tif", "g.webp", "i.png"}


def test_folders_left_out_are_those_below_the_root(spark, tmp_path):
    for folder in ("skip/root/in", "skip/root/skip"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.jpg").write_bytes(b"\xff\xd8")
    assert [r.path.split("/")[-2] for r in files.scan(spark, str(tmp_path / "skip" / "root"), ["skip"]).collect()] == ["in"]
