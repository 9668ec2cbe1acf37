"""Every operator against the plain contract, over odd documents, empty tables and the smallest generated tables."""

import math

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from cairnmark.llm import queries as Q
from cairnmark.llm.byte_bpe import decode, digests, encode
from cairnmark.llm.decontaminate import contamination
from cairnmark.llm.language_model import score_texts
from cairnmark.llm.license_scan import licenses
from cairnmark.llm.quality import quality
from cairnmark.llm.simhash import near_duplicates
from cairnmark.llm.suffix_dedup import removed
from cairnmark.llm.token_counts import token_counts
from cairnmark.llm.token_store import lookup, read_documents, round_trip, write_store
from llm import brute, fixtures

PIECE, WORD, BYTE = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
#: The operator over documents, the plain contract over (doc_id, text), and the columns that both give.
CASES = {
    "op3": (lambda d: token_counts(d, PIECE), brute.piece_counts, "doc_id n_bytes n_tokens over_limit"),
    "op4": (lambda d: round_trip(d, WORD), brute.token_store, "doc_id start n_tokens ids_crc32"),
    "op5": (near_duplicates, brute.components, "doc_id fingerprint component_id"),
    "op6": (lambda d: digests(d, BYTE, public_tokenizers.PATTERN), brute.byte_bpe, "doc_id n_tokens ids_sha256 decoded_sha256"),
    "op7": (removed, brute.removed, "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op8": (quality, brute.rules, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"),
    "op9": (licenses, brute.phrases, "doc_id n_words n_base first_word last_word base_labels"),
    "op10": (lambda d: score_texts(d, BYTE), brute.unigram, "doc_id held_out n_tokens n_known train_tokens base_score"),
}
QUERY = {k: next(n for n in Q.queries() if n.startswith(f"{k}_")) for k in ("op2", *CASES)}


def plain(rows):
    rows = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("op", CASES)
def test_odd_documents(spark, op):
    run, contract, columns = CASES[op]
    rows = fixtures.documents()
    got = run(fixtures.frame(spark, rows)).select(*columns.split()).collect()
    assert plain(got) == plain(contract(pairs(rows)))


@pytest.mark.parametrize("op", CASES)
def test_empty_table(spark, op):
    run, _, columns = CASES[op]
    assert run(fixtures.frame(spark, [])).select(*columns.split()).collect() == []


@pytest.mark.parametrize("op", CASES)
def test_only_null_and_empty_texts(spark, op):
    run, contract, columns = CASES[op]
    rows = [(2, None, None, None, None), (9, "", "en", "web", 0), (9, "", "en", "web", 0)]
    got = run(fixtures.frame(spark, rows)).select(*columns.split()).collect()
    assert plain(got) == plain(contract(pairs(rows)))


@pytest.mark.parametrize("op", CASES)
def test_generated_documents(spark, sf_dir, op):
    _, contract, columns = CASES[op]
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    got = Q.queries()[QUERY[op]](spark, sf_dir).select(*columns.split()).collect()
    assert plain(got) == plain(contract(list(zip(*table.to_pydict().values(), strict=True))))


def test_contamination(spark):
    rows = fixtures.documents()
    got = contamination(fixtures.frame(spark, rows), fixtures.items(spark)).drop("uid").collect()
    assert plain(got) == plain(brute.contamination(pairs(rows), fixtures.ITEMS))


def test_contamination_of_empty_tables(spark):
    docs, items = fixtures.frame(spark, []), fixtures.items(spark)
    assert contamination(docs, items).collect() == []
    found = contamination(fixtures.frame(spark), items.limit(0)).collect()
    assert len(found) == len(fixtures.documents()) and not any(r.n_hit or r.contaminated for r in found)


def test_store_looks_up_keys_and_misses(spark):
    docs = fixtures.frame(spark, [r for r in fixtures.documents() if r[0] is not None and r[0] >= 1000])
    store = write_store(docs, WORD, 2, shard=500)
    keys = spark.createDataFrame([(1003, 0), (1029, 0), (77, 0)], "key long, copy int")
    found = read_documents(store, lookup(store, keys)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    texts = dict(pairs(fixtures.documents()))
    assert sorted(r[0] for r in found) == [1003, 1029]
    for r in found:
        want = [*t.encode(texts[r[0]], add_special_tokens=False).ids, 2]
        raw = next(x for x in r if isinstance(x, bytes | bytearray))
        assert len(raw) in (2 * len(want), 4 * len(want))


def test_bytes_of_ids_decode_to_the_text(spark):
    rows = [(r[0], r[1]) for r in fixtures.documents() if r[0] is not None and r[0] >= 1000]
    coded = encode(fixtures.frame(spark, [(*r, None, None, None) for r in rows]), BYTE, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(next(x for x in reversed(r) if isinstance(x, bytes | bytearray))).decode() for r in decode(coded, BYTE).collect()}
    assert back == dict(rows)


def test_quality_keeps_prose_and_rejects_noise(spark):
    import random

    rng = random.Random(3)
    rows = [(i, fixtures.sentences(i, 200), "en", "web", 1) for i in range(200)]
    noise = "".join(chr(rng.randrange(33, 127)) if rng.random() < 0.9 else " " for _ in range(3000))
    rows += [(500, noise, "en", "web", 1), (501, "zq" * 700 + " a" * 30, "en", "web", 1), (502, "too short", "en", "web", 1)]
    kept = {r.doc_id: r.kept for r in quality(fixtures.frame(spark, rows)).collect()}
    assert not any(kept[i] for i in (500, 501, 502))
    assert all(kept[i] for i in range(200))


def test_licence_templates_add_labels(spark):
    from cairnmark.llm.license_scan import TEMPLATES

    rows = [(i, f"intro words here {t} closing words", "en", "web", 1) for i, t in enumerate(TEMPLATES.values())] + [(99, fixtures.PROSE, "en", "web", 1)]
    found = {r.doc_id: r for r in licenses(fixtures.frame(spark, rows)).collect()}
    for i, label in enumerate(TEMPLATES):
        assert label in found[i].labels.split(",") and found[i].score > 0.9
    assert found[99].labels == "" and found[99].score == 0


def test_language_model_is_a_log_probability_that_training_improves(spark, sf_dir):
    found = Q.op10_language_model(spark, sf_dir).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    again = {r.doc_id: r.score for r in Q.op10_language_model(spark, sf_dir).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 * abs(r.score) + 1e-6 for r in found)
    untrained = {r.doc_id: r.score for r in score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE, 0).collect()}
    held = [r for r in found if r.held_out]
    trained, begun, base = sum(r.score for r in held), sum(untrained[r.doc_id] for r in held), sum(r.base_score for r in held)
    assert held and trained > begun and trained > 1.25 * base
    texts = dict(zip(*(pq.read_table(f"{sf_dir}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    subwords = sum(r[1] for r in brute.byte_bpe([(r.doc_id, texts[r.doc_id]) for r in held]))
    assert trained > 0.6 * subwords * math.log10(1 / 50257)


def test_quality_rejects_texts_of_mostly_noise(spark):
    import random

    rng = random.Random(5)
    rows = [(i, fixtures.sentences(i, 200), "en", "web", 1) for i in range(200)]
    noise = "".join(chr(rng.randrange(33, 127)) if rng.random() < 0.85 else " " for _ in range(2100))
    rows += [(500, noise + " " + fixtures.sentences(901, 150), "en", "web", 1)]
    kept = {r.doc_id: r.kept for r in quality(fixtures.frame(spark, rows)).collect()}
    assert not kept[500] and all(kept[i] for i in range(200))


def test_every_language_has_a_model(spark):
    from cairnmark.llm.quality import fit_models, gram_counts

    rows = [(i, fixtures.sentences(i, 200), "en", "web", 1) for i in range(100)] + [(500, "kivi on kova", "fi", "web", 1), (501, "jiwe ni gumu", "sw", "web", 1)]
    assert {"en", "fi", "sw"} <= set(fit_models(gram_counts(fixtures.frame(spark, rows))))


def test_a_licence_passage_that_stands_twice_chains_at_both_places(spark):
    from cairnmark.llm.license_scan import TEMPLATES

    passage = "above copyright notice, this list of conditions and the following disclaimer"
    head, middle, tail = TEMPLATES["bsd-text"].split(passage)
    rows = [(1, f"{head}{passage}{middle} edited {passage} edited {tail}", "en", "web", 1)]
    assert licenses(fixtures.frame(spark, rows)).first().score == 1


def test_a_passage_in_a_third_of_all_texts(spark, monkeypatch):
    from cairnmark.llm import suffix_dedup

    rows = [(i, fixtures.sentences(i, 40) + (f" {fixtures.PASSAGE} " if i % 3 == 0 else "") + fixtures.sentences(900 + i, 40), "en", "web", 1) for i in range(240)]
    want = plain(brute.removed(pairs(rows)))
    for piece in (suffix_dedup.PIECE, 7, 100):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        assert plain(removed(fixtures.frame(spark, rows).repartition(6)).collect()) == want
    monkeypatch.setattr(suffix_dedup, "SMALL", 0)
    assert plain(removed(fixtures.frame(spark, rows)).collect()) == want


def test_suffix_ranks_are_the_bytes_order():
    import numpy as np

    from cairnmark.llm.suffix_dedup import suffix_ranks

    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 3, 300), np.zeros(150), rng.integers(250, 256, 50), np.tile(rng.integers(0, 200, 120), 3)]).astype(np.uint8)
    raw = data.tobytes()
    for length in (5, 8, 9, 16, 30, 100):
        at = rng.permutation(len(raw) - length + 1)
        cut = [raw[i : i + length] for i in at.tolist()]
        ranked = sorted(cut)
        order = {x: r for r, x in reversed(list(enumerate(ranked)))}
        assert suffix_ranks(data, at, length).tolist() == [order[x] for x in cut]
    assert len(suffix_ranks(data[:3], np.zeros(0, np.int64), 8)) == 0


def test_an_id_with_a_third_of_all_rows_is_dealt_in_ranges(spark):
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else 1000 + i, fixtures.sentences(i, 30), "en", "web", 1) for i in range(300)]
    docs = fixtures.frame(spark, rows)
    assert plain(round_trip(docs, WORD).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == plain(brute.token_store(pairs(rows)))
    store = write_store(docs, WORD, 2)
    assert max(r["count"] for r in store.shards.selectExpr("part", "explode(keys) k").groupBy("part").count().collect()) < 120
    found = lookup(store, spark.createDataFrame([(5, 0), (5, 99), (None, 57), (5, 100)], "key long, copy long"))
    assert sorted((r.key or 0, r.copy) for r in found.collect()) == [(0, 57), (5, 0), (5, 99)]


def test_equal_hashes_are_hashed_anew():
    import numpy as np

    from cairnmark.llm.token_store import _seeded, perfect_hash

    h, check = np.array([7, 7, 9], np.uint64), np.array([1, 2, 2], np.uint64)
    found = _seeded(h, check, 0)
    assert len(set(found.tolist())) == 3 and sorted(perfect_hash(found)[1].tolist()) == [0, 1, 2]
    assert set(found.tolist()).isdisjoint(_seeded(h, check, 1).tolist())


def test_lines_and_words_of_equal_hashes_are_told_apart():
    import numpy as np

    from cairnmark.llm import ragged
    from cairnmark.llm.quality import rule_counts

    thue = "a"
    for _ in range(10):
        thue += thue.translate({97: 98, 98: 97})
    other = thue.translate({97: 98, 98: 97})
    rest = " one two three four five six seven"
    texts = [f"{thue}\n{other}", f"{thue}{rest}\n{other}{rest}", f"{thue}{rest}\n{thue}{rest}", "x\n\nx\n x", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data_sums = ragged.prefix(data[: 2 * len(thue) + 1])
    assert ragged.span_hash(data_sums, np.array([0, len(thue) + 1]), np.array([len(thue), 2 * len(thue) + 1]))[0] == ragged.span_hash(data_sums, np.array([len(thue) + 1]), np.array([2 * len(thue) + 1]))[0]
    got = rule_counts(data, offs)
    assert got["n_dup_lines"].tolist() == [0, 0, 1, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 16, 0, 0]
    for window in (1, 3, 5, 8):
        words = [(i, t) for i, t in enumerate(["a b a b c a b", "a b", "", "q " * 9])]
        flat = np.frombuffer("".join(t for _, t in words).encode(), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in words])])
        want = []
        for _, t in words:
            w = t.split()
            wins = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
            want.append(len({i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(window)}))
        assert rule_counts(flat, edges, window)["n_repeat_words"].tolist() == want


def test_one_long_text_costs_as_much_as_many(spark):
    import random
    import time

    rng = random.Random(1)
    parts = ["".join(rng.choices("abcdefghij klmnop", k=300)) for _ in range(400)]
    text = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij klmnop", k=300)) for _ in range(10_000))
    took = []
    for texts in ([text[i : i + 20_000] for i in range(0, len(text), 20_000)], [text]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        began = time.time()
        found = removed(docs).agg({"n_removed": "sum"}).first()[0]
        took.append(time.time() - began)
        assert found > 1_000_000
    assert took[1] < 2.5 * took[0] + 3
