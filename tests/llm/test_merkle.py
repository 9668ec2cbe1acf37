"""The manifest against a plain tree of hashes."""

import random

import pyarrow.parquet as pq
import pytest

from cairnmark.llm import queries as Q
from cairnmark.llm.merkle import every_fifth_lowered, manifest
from llm import brute, fixtures

ROW = "doc_id text lang source n_chars".split()


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def found(df, **more):
    return plain(manifest(df, other_text=every_fifth_lowered(), **more).collect())


def test_generated_documents(spark, sf_dir):
    rows = list(zip(*(pq.read_table(f"{sf_dir}/documents.parquet", columns=ROW).to_pydict()[c] for c in ROW), strict=True))
    assert plain(Q.queries()["op13_merkle_manifest"](spark, sf_dir).collect()) == plain(brute.manifest(rows))


def test_odd_documents(spark):
    rows = fixtures.documents()
    assert found(fixtures.frame(spark, rows)) == plain(brute.manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 33, 257])
def test_sizes_of_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "web", i) for i in range(n)]
    assert found(fixtures.frame(spark, rows)) == plain(brute.manifest(rows))


def test_many_sources_hot_copies_and_other_fanout(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.choice(["Aa", "b", None, ""]), rng.choice(["en", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(60)}", rng.choice([1, None])) for _ in range(600)]
    rows += [(7, "Same", "en", "hot", 4)] * 300 + [(1, "x", "en", None, 1), (2, "Y", "en", "", 1), (5, "É Z", "en", "é", 3)]
    assert found(fixtures.frame(spark, rows), fanout=4) == plain(brute.manifest(rows, 4))


def test_only_a_changed_copy_fails(spark):
    rows = [(i, "lower" if i % 2 else "Upper", "en", f"s{i % 3}", 5) for i in range(200)]
    import zlib

    got = {r.doc_id: r.verified for r in manifest(fixtures.frame(spark, rows), other_text=every_fifth_lowered()).collect()}
    assert got == {i: bool(i % 2) or zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)}


def test_written_tables_end_when_asked(spark):
    import os

    from cairnmark.llm import shared

    shared.release_tables(spark)
    one, two = shared.written(spark.range(3).toDF("a"), "some"), shared.in_buckets(spark.range(3).toDF("a"), "other", 2, "a")
    paths = [p.removeprefix("file://") for p, _ in shared._written]
    assert one.count() == two.count() == 3 and all(map(os.path.isdir, paths))
    assert shared.release_tables(spark) == 2 and not any(map(os.path.exists, paths)) and not [t for t in spark.catalog.listTables() if t.name.startswith("cairnmark_other")]
