"""Every registered query with SQL, held against it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from cairnmark.plans import curation, density, pages, queries as plans, runs, upkeep  # noqa: F401

from compare import differences, oracle



@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    said = differences(spark, con, plans.queries()[name], plans.oracle_sql()[name], sf_dir)
    assert said in ("", "empty"), said


def test_all_queries_have_sql():
    assert set(plans.queries()) == set(plans.oracle_sql()) | plans.UNEXPRESSED
    assert plans.UNEXPRESSED == {"catalogue_after_moves", "hierarchy_grid", "hierarchy_labels", "manual_faces_in_order"}


@pytest.mark.parametrize("name", sorted(plans.UNEXPRESSED))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count()


def test_entry(spark):
    assert entry.entry(spark).columns
