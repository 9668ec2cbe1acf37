"""Nearest trips against all pairs of days and trips."""

import datetime
import random

import pytest

from cairnmark.operators import trips as T
from cairnmark.operators.ordering import places

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("seed, n, limit", [(1, 40, 2), (2, 7, 5), (3, 0, 2), (4, 60, 1)])
def test_nearest_trips(spark, seed, n, limit):
    rng = random.Random(seed)
    at = lambda k: DAY + datetime.timedelta(days=k)
    trips = []
    for i in range(n):
        a = rng.randrange(120)
        trips.append((100 - i, None if rng.random() < 0.1 else at(a), rng.choice([None, at(a), at(a + rng.randrange(15)), at(a - 3)])))
    days = [at(k) for k in range(-10, 150, 3)] + [at(2)] * 3 + [None]
    got = T.nearest_trips(spark.createDataFrame([(d,) for d in days], "day date"), spark.createDataFrame(trips, "id long, start_date date, end_date date"), limit).collect()
    want = set()
    for d in {d for d in days if d}:
        near = []
        for i, a, b in trips:
            if a:
                b = max(a, b or a)
                near.append((86400 * ((a - d).days if d < a else (d - b).days if d > b else 0), i))
        want |= {(d, i, k + 1, s) for k, (s, i) in enumerate(sorted(near)[:limit])}
    assert {(r.day, r.trip_id, r["rank"], r.seconds) for r in got} == want and len(got) == len(want)


def test_places_without_keys(spark):
    rows = [(i * 7919 % 101,) for i in range(101)]
    got = places(spark.createDataFrame(rows, "v long"), [], ["v"]).collect()
    assert all(r.v == r.place for r in got) and len(got) == 101


def test_import_of_trip_tables(spark, tmp_path):
    from cairnmark.sources.lists import trip_rows

    head = "Страна;;Въезд;Выезд\n;;;\n"
    first = head + "Перу;x;01.02.2024;10.02.2024\nЧили;;16.052023;24 04.2023\n;;01.01.2024;\nОман;;never;\nКения;;03.03.2024;\n"
    second = head + "Перу;;05.02.2024;01.02.2024\nКуба;;01.01.2020;02.01.2020\n"
    for name, text, code in (("a.csv", first, "cp1251"), ("b.csv", second, "utf-8-sig")):
        (tmp_path / name).write_bytes(text.encode(code))
    rows = trip_rows(spark.read.format("binaryFile").load(str(tmp_path)))
    d = datetime.date
    assert sorted((r.name, r.place_country, r.start_date, r.end_date) for r in rows.collect()) == sorted([("2024 Перу", "Перу", d(2024, 2, 1), d(2024, 2, 10)), ("2023 Чили", "Чили", d(2023, 4, 24), d(2023, 5, 16)), ("2024 Кения", "Кения", d(2024, 3, 3), d(2024, 3, 3)), ("2024 Перу", "Перу", d(2024, 2, 1), d(2024, 2, 5)), ("2020 Куба", "Куба", d(2020, 1, 1), d(2020, 1, 2))])
    trips = spark.createDataFrame([(1, " 2023 Чили ", d(2000, 1, 1), None, "?"), (2, "other", None, None, None)], "id long, name string, start_date date, end_date date, place_country string")
    files = spark.createDataFrame([(1, "2024-02-09T01:02:03Z"), (2, "bad"), (3, None), (4, "2024-03-04")], "id long, taken_at string")
    got = sorted((r.id or 0, r.name, r.start_date, r.end_date, r.place_country) for r in T.imported(trips, rows, files).where("id <> 2 OR id IS NULL").collect())
    assert got == [(0, "2024 Перу", d(2024, 2, 1), d(2024, 2, 5), "Перу"), (1, " 2023 Чили ", d(2023, 4, 24), d(2023, 5, 16), "Чили")]
