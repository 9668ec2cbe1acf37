"""Upserts by column rules against plain dictionaries; parts that stay as they are; commits."""

import random

import pytest
from pyspark.sql import functions as F

from cairnmark.operators.keyed import FILLED, OLD, KeyedTable, merged

SCHEMA = "key string, lat double, raw string, made string"
RULES = {"raw": FILLED, "made": OLD}


def plain(old, new):
    out = {r[0]: r for r in old}
    best = {}
    for r in new:
        mark = tuple((x is not None, x) for x in r[1:])
        if r[0] not in best or mark > best[r[0]][0]:
            best[r[0]] = (mark, r)
    for key, (_, r) in best.items():
        was = out.get(key)
        out[key] = r if was is None else (key, r[1], r[2] if r[2] is not None else was[2], was[3])
    return out


def drawn(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *"abcdefghijkl"]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "r", "s"]), rng.choice([None, "m", "n"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged(spark, seed):
    old = list({r[0]: r for r in drawn(seed, 8)}.values())
    new = drawn(seed + 10, 20)
    got = merged(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["key"], RULES).collect()
    want = plain(old, new)
    assert {r.key: tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert {r.key for r in got if r.changed} == {k for k, r in want.items() if r not in old}


def test_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["key"], 8)
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], SCHEMA), RULES) == []
    rows = [(str(i), float(i), f"raw{i}", "first") for i in range(40)]
    written = table.merge(spark.createDataFrame(rows, SCHEMA), RULES)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(rows) and len(written) > 4
    before = table._list()
    assert table.merge(spark.createDataFrame([("3", 3.0, None, "second"), ("4", 4.0, "raw4", None)], SCHEMA), RULES) == [] and table._list() == before
    changed = table.merge(spark.createDataFrame([("3", 9.0, None, "second")], SCHEMA), RULES)
    assert len(changed) == 1 and sum(table._list()[1][k] != v for k, v in before[1].items()) == 1
    assert [tuple(r) for r in table.read().where(F.col("key") == "3").collect()] == [("3", 9.0, "raw3", "first")] and table.read().count() == 40


def test_a_merge_from_an_old_list_fails_and_leaves_the_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["key"], 4)
    table.merge(spark.createDataFrame([("a", 1.0, None, None)], SCHEMA), RULES)
    late = KeyedTable(spark, table.path, SCHEMA, ["key"], 4)
    begun = late._list()
    table.merge(spark.createDataFrame([("a", 2.0, None, None)], SCHEMA), RULES)
    late._list = lambda: begun
    with pytest.raises(Exception, match="exists"):
        late.merge(spark.createDataFrame([("a", 3.0, None, None)], SCHEMA), RULES)
    assert [r.lat for r in table.read().collect()] == [2.0]
