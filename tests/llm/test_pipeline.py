"""The stages of the corpus pipeline against brute force, each on its own input."""

import corpus_pipeline as P
import pytest

from llm import brute, fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.frame(spark, clash=True)


def rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def plain(r):
    return sorted(r, key=key)


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicate_groups", "repeated_passages", "contaminated_documents", "token_ids"]


def test_quality_stage_drops_what_the_rules_reject(spark, docs, sf_dir):
    failed = {r[0] for r in brute.rules([(d, t) for d, t, *_ in fixtures.documents()]) if r[-1]}
    passed = {r[0] for r in brute.rules([(d, t) for d, t, *_ in fixtures.documents()]) if not r[-1]}
    kept = {r[0] for r in rows(P.quality_rules(spark, docs, sf_dir))}
    assert not kept & (failed - passed)
    assert {1000 + i for i in range(30)} <= kept


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, sf_dir):
    groups = brute.components([(d, t) for d, t, *_ in fixtures.documents()])
    want = {c for _, _, c in groups if c is not None}
    got = rows(P.near_duplicate_groups(spark, docs, sf_dir))
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(want)


def test_passage_stage_removes_repeats_and_keeps_characters(spark, docs, sf_dir):
    before = {r[0]: r for r in brute.removed([(d, t) for d, t, *_ in fixtures.documents()])}
    got = rows(P.repeated_passages(spark, docs, sf_dir))
    assert len(got) == len(fixtures.documents())
    unique = {d for d in before if sum(r[0] == d for r in fixtures.documents()) == 1}
    for d, text, *_, n_chars in got:
        assert n_chars == len(text)
        if d in unique:
            n_bytes, n_removed, n_spans = before[d][1:4]
            assert 0 <= len(text.encode()) - (n_bytes - n_removed) <= 6 * n_spans


def test_contamination_stage(spark, docs, sf_dir):
    import pyarrow.parquet as pq

    items = list(zip(*pq.read_table(f"{sf_dir}/benchmark.parquet").select(["item_id", "text"]).to_pydict().values(), strict=True))
    hit = fixtures.frame(spark, [(1, items[0][1], "en", "w", 1), (2, fixtures.PROSE, "en", "w", 1), (3, None, None, None, None)])
    assert plain(r[:1] for r in rows(P.contaminated_documents(spark, hit, sf_dir))) == [(2,), (3,)]


def test_last_stage(spark, docs, sf_dir):
    got = P.token_ids(spark, docs, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert plain(tuple(r) for r in got) == plain(brute.byte_bpe([(d, t) for d, t, *_ in fixtures.documents()]))


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_empty(spark, sf_dir, stage):
    assert stage(spark, fixtures.frame(spark, []), sf_dir).collect() == []


def test_run_is_its_stages_one_after_the_other(spark, sf_dir):
    """The quality verdicts are the operator's own; everything behind them is plain Python."""
    import pyarrow.parquet as pq

    from cairnmark.llm.quality import quality

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in quality(table).where("kept").collect()}
    docs = [d for d in docs if d[0] in kept]
    first = {r[-1] for r in brute.components(docs)}
    docs = brute.without_repeats([d for d in docs if d[0] in first])
    items = list(zip(*pq.read_table(f"{sf_dir}/benchmark.parquet").select(["item_id", "text"]).to_pydict().values(), strict=True))
    bad = {r[0] for r in brute.contamination(docs, items) if r[-1]}
    want = brute.byte_bpe([d for d in docs if d[0] not in bad])
    got = P.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert plain(tuple(r) for r in got) == plain(want) and 0 < len(want) < table.count()


@pytest.mark.parametrize("one", [7, None])
def test_rows_of_one_id_are_judged_apart(spark, sf_dir, one):
    import pyarrow.parquet as pq

    def texts(stage, given):
        return sorted(r[1] for r in rows(stage(spark, fixtures.frame(spark, [(one, t, "en", "w", 1) for t in given]), sf_dir)))

    good = [fixtures.sentences(i, 200) for i in range(30)]
    assert texts(P.quality_rules, [*good, "too short"]) == sorted(good)
    assert texts(P.near_duplicate_groups, [*good, *good]) == sorted(good)
    item = pq.read_table(f"{sf_dir}/benchmark.parquet").column("text")[0].as_py()
    assert texts(P.contaminated_documents, [*good, item]) == sorted(good)


def test_near_duplicate_stage_takes_one_row_of_a_repeated_id(spark, sf_dir):
    other = fixtures.sentences(1, 200)
    given = [(9, fixtures.PASSAGE, "en", "w", 1), (4, fixtures.PASSAGE, "en", "w", 1), (4, fixtures.PASSAGE, "en", "w", 1), (None, fixtures.PASSAGE, "en", "w", 1), (4, other, "en", "w", 1)]
    assert sorted((r[0], r[1]) for r in rows(P.near_duplicate_groups(spark, fixtures.frame(spark, given), sf_dir))) == sorted([(4, fixtures.PASSAGE), (4, other)])
