"""Free names against a plain loop."""

import random
import re

import pytest

from cairnmark.operators.naming import free_names


def plain(rows, there):
    taken, out = set(there), {}
    for _, i, folder, name in sorted(rows):
        if name is None:
            out[i] = None
            continue
        stem, ext = re.match(r"^(.*?)(\.[^.]*)?$", name, re.S).groups("")
        n = 0
        while (folder, found := name if n == 0 else f"{stem} ({n}){ext}") in taken:
            n += 1
        taken.add((folder, found))
        out[i] = found
    return out


def found(spark, rows, there):
    df = free_names(spark.createDataFrame(rows, "o long, id long, folder string, name string"), spark.createDataFrame(there, "folder string, name string"), ["o", "id"])
    return {r.id: r.unique_name for r in df.collect()}


@pytest.mark.parametrize(
    "rows, there",
    [
        ([(1, 1, "f", "a.jpg"), (2, 2, "f", "a.jpg"), (3, 3, "g", "a.jpg"), (4, 4, "f", None)], [("f", "a.jpg"), ("f", "a (2).jpg"), ("f", "a (4).jpg"), ("f", "a (01).jpg"), ("f", "a.JPG")]),
        ([(1, 1, "f", "a.jpg"), (2, 2, "f", "a (1).jpg"), (3, 3, "f", "a.jpg"), (4, 4, "f", "a (1).jpg")], [("f", "a.jpg")]),
        ([(2, 1, "f", "a (1).jpg"), (1, 2, "f", "a (1).jpg")], [("f", "a.jpg"), ("f", "a (1).jpg"), ("f", "a (1) (1).jpg")]),
        ([(i, i, None if i % 2 else "", "x") for i in range(6)], [("", "x (1)")]),
        ([], [("f", "a")]),
    ],
)
def test_cases(spark, rows, there):
    where = lambda f: f or ""
    assert found(spark, rows, there) == plain([(o, i, where(f), n) for o, i, f, n in rows], [(where(f), n) for f, n in there])


def test_many_newcomers_and_gaps(spark):
    rng = random.Random(4)
    names = ["a.jpg", "b", ".c", "d.e.f", "a b (x).jpg", "q (3).png"]
    rows = [(rng.randrange(10**6), i, rng.choice("fg"), rng.choice(names)) for i in range(400)]
    there = [(rng.choice("fg"), n if k == 0 else re.sub(r"^(.*?)(\.[^.]*)?$", lambda m, k=k: f"{m[1]} ({k}){m[2] or ''}", n, count=1)) for n in names for k in rng.sample(range(90), 30)]
    assert found(spark, rows, there) == plain(rows, there)
