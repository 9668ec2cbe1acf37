"""The field's sums against all labellings, its gradient against differences, its scores against held-out labels."""

import itertools
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cairnmark.llm import line_crf as C
from cairnmark.llm import queries as Q
from cairnmark.llm import ragged
from llm import fixtures


def block(*texts):
    return ragged.text_bytes(pa.array(texts, pa.string()))


def drawn(seed):
    rng = np.random.default_rng(seed)
    return C.Field(rng.normal(0, 0.5, C.WIDTH).astype(np.float32), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))


def weigh(field, x, y):
    """Log weight of the labels ``y`` of one text's lines."""
    return field.start[y[0]] + sum(field.move[a, b] for a, b in itertools.pairwise(y)) + sum(float(f @ field.weights) for f, s in zip(x, y, strict=True) if s)


def test_lines_of_texts():
    starts, ends, first = C.line_bounds(*block("a\nb", "", None, "\n", "c\n\nd\n"))
    assert first.tolist() == [0, 2, 3, 4, 6, 10] and (ends - starts).tolist() == [1, 1, 0, 0, 0, 0, 1, 0, 1, 0]


@pytest.mark.parametrize("seed", range(4))
def test_marginals_are_sums_over_all_labellings(seed):
    field = drawn(seed)
    own, _, first = C.line_features(*block("one two\nTHREE!! four", "", "a | b | c\n\n$$$ x\n5 6 7\nsame\nsame", "x"))
    x = C.with_neighbours(own, first)
    good, pairs = field.marginals(x, first)
    for a, b in itertools.pairwise(first.tolist()):
        ways = list(itertools.product([0, 1], repeat=b - a))
        p = np.exp([weigh(field, x[a:b], y) for y in ways])
        p /= p.sum()
        assert good[a:b] == pytest.approx([sum(q for q, y in zip(p, ways, strict=True) if y[i]) for i in range(b - a)], abs=1e-6)
        for i in range(1, b - a):
            want = [[sum(q for q, y in zip(p, ways, strict=True) if (y[i - 1], y[i]) == (s, t)) for t in (0, 1)] for s in (0, 1)]
            assert pairs[a + i] == pytest.approx(np.array(want), abs=1e-6)
        assert not pairs[a].any()


def test_a_neighbour_changes_a_line():
    field = drawn(9)
    one, two = (C.line_features(*block(t)) for t in ("the same line\nplain words here", "the same line\n$$$ !! |"))
    assert (one[0][0] == two[0][0]).all()
    assert abs(field.marginals(C.with_neighbours(one[0], one[2]), one[2])[0][0] - field.marginals(C.with_neighbours(two[0], two[2]), two[2])[0][0]) > 1e-6


def test_the_slope_of_the_likelihood(monkeypatch):
    texts = ["one two\nTHREE!! four", "$$$ x\n5 6 7\nsame", "plain"]
    own, _, first = C.line_features(*block(*texts))
    x, y, field = C.with_neighbours(own, first), np.array([1, 0, 1]), drawn(1)

    def likelihood(f):
        total = 0.0
        for k, (a, b) in enumerate(itertools.pairwise(first.tolist())):
            ways = [weigh(f, x[a:b], w) for w in itertools.product([0, 1], repeat=b - a)]
            total += weigh(f, x[a:b], [y[k]] * (b - a)) - np.log(np.exp(ways).sum())
        return total

    good, pairs = field.marginals(x, first)
    lines = np.repeat(y, np.diff(first))
    for j in (0, 5, C.OWN, C.WIDTH - 1):
        up, down = (C.Field((field.weights.astype(float) + e * (np.arange(C.WIDTH) == j)), field.move, field.start) for e in (1e-4, -1e-4))
        assert (likelihood(up) - likelihood(down)) / 2e-4 == pytest.approx(((lines - good) * x[:, j]).sum(), abs=1e-3)
    up, down = (C.Field(field.weights, field.move + e * np.array([[0, 1], [0, 0]]), field.start) for e in (1e-4, -1e-4))
    assert (likelihood(up) - likelihood(down)) / 2e-4 == pytest.approx(-pairs[:, 0, 1].sum(), abs=1e-3)


def test_held_out_labels(spark, sf_dir):
    quality = dict(zip(*(pq.read_table(f"{sf_dir}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")), strict=True))
    rows = Q.queries()["op12_line_crf"](spark, sf_dir).collect()
    assert len(rows) == pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(quality[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert good and bad and sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(s >= 0.7 for s in good) >= 0.95 * len(good) and sum(s < 0.7 for s in bad) >= 0.8 * len(bad)


def test_scores_depend_on_the_text_alone(spark):
    rows = fixtures.documents()
    labels = spark.createDataFrame([(r[0], i % 3 % 2, 0) for i, r in enumerate(rows)] + [(None, 1, 0), (9999, 1, 1), (0, None, 0)], "doc_id long, quality int, toxic int")
    got = C.line_quality(fixtures.frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    field = C.train(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), labels.selectExpr("doc_id", "quality as label"))
    by_text = {}
    for r, s in zip(rows, C.scores(fixtures.frame(spark, rows).coalesce(1), field).collect(), strict=True):
        assert by_text.setdefault(r[1] or "", s.score) == pytest.approx(s.score, abs=1e-5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert C.line_quality(fixtures.frame(spark, []), none).collect() == []
    assert {r.score for r in C.line_quality(fixtures.frame(spark), none).collect()} == {0.5}


def test_very_long_texts():
    began = time.process_time()
    own, _, first = C.line_features(*block("short line\n" * 300_000, "one line " * 200_000, ""))
    good, _ = drawn(3).marginals(C.with_neighbours(own, first), first)
    assert len(good) == 300_003 and np.isfinite(good).all() and time.process_time() - began < 30
