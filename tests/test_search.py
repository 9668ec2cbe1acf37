"""Pages of a searched list against a plain scan."""

import random

import pytest

from cairnmark.operators.search import Index


def plain(items, wanted, after, limit):
    hits = [x for x in items if wanted.strip().lower() in x.lower()]
    begin = hits.index(after.strip()) + 1 if (after or "").strip() in hits else 0
    size = max(10, min(300, limit))
    return [(x, len(hits), begin + size < len(hits)) for x in hits[begin : begin + size]]


@pytest.fixture(scope="module")
def listed(spark):
    rng = random.Random(3)
    items = list(dict.fromkeys(f"disk:/{rng.choice(['Фото', 'src', 'İx'])}/{rng.choice(['Straße', 'a%b_', 'IMG'])}{rng.randrange(200)}.jpg" for _ in range(300)))
    rng.shuffle(items)
    index = Index.of(spark.createDataFrame([*enumerate(items), (999, None)], "line long, entry string"), ["line"])
    return items, index


@pytest.mark.parametrize("wanted", ["", " IMG ", "g1", "7", "фото/", "straße1", "a%b_", "nothing here", "jpg", "disk:/src/img1", "zzz"])
def test_pages(listed, wanted):
    items, index = listed
    for after, limit in ((None, 10), ("", 500), (next((x for x in items if wanted.strip().lower() in x.lower()), "x"), 15), ("not in the list", 10)):
        got = [(r.entry, r.total, r.more) for r in sorted(index.page(wanted, after, limit).collect(), key=lambda r: r.place)]
        assert got == plain(items, wanted, after, limit)


def test_pages_follow_each_other(listed):
    items, index = listed
    seen, after = [], None
    while True:
        page = sorted(index.page("img", after, 40).collect(), key=lambda r: r.place)
        seen += [r.entry for r in page]
        if not page[-1].more:
            break
        after = page[-1].entry
    assert seen == [x for x in items if "img" in x.lower()]


def test_postings_are_pruned(listed):
    _, index = listed
    plan = index.found("straße19")._jdf.queryExecution().toString()
    assert "In(gram" in plan.replace(" ", "") or "gramIN" in plan.replace(" ", "")


def test_empty_list(spark):
    assert Index.of(spark.createDataFrame([], "entry string"), ["entry"]).page("abc").collect() == []
