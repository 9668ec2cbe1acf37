"""Divergences of sources against plain whole-number arithmetic."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from cairnmark.llm import queries as Q
from cairnmark.llm.divergence import _shares, divergences
from llm import brute, fixtures

ROW = "doc_id text lang source".split()


def found(df, **more):
    return sorted(tuple(r) for r in divergences(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_generated_documents(spark, sf_dir):
    rows = list(zip(*(pq.read_table(f"{sf_dir}/documents.parquet", columns=ROW).to_pydict()[c] for c in ROW), strict=True))
    got = sorted(tuple(r) for r in Q.queries()["op11_source_divergence"](spark, sf_dir).collect())
    assert got == sorted(brute.divergences(rows)) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("least, piece", [(1, 7), (2, 1 << 13), (10, 3), (10**6, 5)])
def test_odd_documents(spark, least, piece):
    rows = fixtures.documents()
    assert found(fixtures.frame(spark, rows), least=least, piece=piece) == sorted(brute.divergences([r[:4] for r in rows], least))


def test_ties_copies_and_a_hot_source(spark):
    rng = random.Random(5)
    words = [*"abcdefghij", "É", "zß", "日本", "Big"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", "1x-y", "_t_"]), rng.choice(["en", None, ""]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}", 1) for i in range(300)]
    rows += [(7, "copy of a copy", "en", "hot", 1)] * 200
    assert found(fixtures.frame(spark, rows), least=3, top=4, piece=4) == sorted(brute.divergences([r[:4] for r in rows], 3, 4))


def test_empty_tables_and_texts(spark):
    assert found(fixtures.frame(spark, [])) == []
    rows = [(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, "12 ! ?", None, None, 0)]
    assert found(fixtures.frame(spark, rows)) == sorted(brute.divergences([r[:4] for r in rows]))


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randrange(4, 9 * 10**15)
        n = rng.randrange(0, total - 1)
        assert _shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 2) // total


def test_sums_over_several_blocks_of_vectors_and_sources(spark, monkeypatch):
    from cairnmark.llm import divergence

    monkeypatch.setattr(divergence, "_CELLS", 4)
    import pyarrow as pa

    rng = random.Random(2)
    sources, vectors = [f"s{i}" for i in range(7)], [[rng.randrange(4) for _ in range(7)] for _ in range(9)]
    table = [{"lang": "en", "source": s, "n": sum(v[i] for v in vectors), "kept": 9, "lang_n": sum(map(sum, vectors)), "vector": None, "m": None, "terms": None} for i, s in enumerate(sources)]
    table += [{"lang": "en", "source": None, "n": None, "kept": None, "lang_n": None, "vector": [{"source": s, "n": n} for s, n in zip(sources, v, strict=True) if n], "m": 1, "terms": [f"t{j}"]} for j, v in enumerate(vectors)]
    rows = [(0, " ".join(f"t{'abcdefghi'[j]} " * v[i] for j, v in enumerate(vectors)), "en", s) for i, s in enumerate(sources)]
    want = {(s, o): value for _, s, part, o, value, _ in brute.divergences(rows, 0) if part == "pair"}
    if all(any(v) for v in vectors):
        got = {(sources[k], sources[k + 1 + i]): int(x) for k, row in divergence._Piece(pa.Table.from_pylist(table)).pairs() for i, x in enumerate(row)}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == 21
