"""Chains of matches against plain loops; licences of one family; all templates."""

import random

import numpy as np
import pytest

from cairnmark.llm import license_scan as L


def plain_runs(words, templates, least):
    """(end, length, {(template, end)}) of the runs that the next word does not extend, by looking at every place."""
    longest = []
    for i in range(len(words)):
        found = {}
        for t, text in enumerate(templates):
            for e in range(1, len(text) + 1):
                n = 0
                while n < min(i + 1, e) and words[i - n] == text[e - 1 - n]:
                    n += 1
                if n:
                    found.setdefault(n, set()).add((t, e))
        most = max(found, default=0)
        longest.append((most, found.get(most, set())))
    return [(i + 1, n, where) for i, (n, where) in enumerate(longest) if n >= least and (i + 1 == len(words) or longest[i + 1][0] != n + 1)]


def plain_cover(words, templates, least, gap):
    best = {}
    runs = plain_runs(words, templates, least)
    for t, text in enumerate(templates):
        chain = []
        for end, length, where in runs:
            for u, at in sorted(where):
                if u != t:
                    continue
                fresh = [c + min(length, at - e, end - d) for d, e, c in chain if d >= end - length - gap and min(length, at - e, end - d) > 0]
                chain.append((end, at, max([length, *fresh])))
        if chain:
            best[t] = min(max(c for *_, c in chain), len(text))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_chains_of_matches(seed):
    rng = random.Random(seed)
    letters = "abcdefg"[: rng.randrange(2, 8)]
    templates = [[rng.choice(letters) for _ in range(rng.randrange(3, 25))] for _ in range(3)]
    words = []
    while len(words) < 60:
        t = rng.choice(templates)
        a = rng.randrange(len(t))
        words += t[a : a + rng.randrange(1, 12)] if rng.random() < 0.7 else [rng.choice(letters) for _ in range(rng.randrange(4))]
    automaton = L.Automaton({str(i): " ".join(t) for i, t in enumerate(templates)})
    hashes = L._hashes_of(" ".join(words))
    known = np.isin(hashes, automaton.vocabulary)
    cut = len(words) if known.all() else int(np.flatnonzero(~known)[0])
    ids = np.searchsorted(automaton.vocabulary, hashes[:cut]).tolist()
    for least, gap in ((1, 5), (2, 3), (3, 30)):
        runs = automaton.runs(ids, least)
        assert [(e, n) for e, n, _ in runs] == [(e, n) for e, n, _ in plain_runs(words[:cut], templates, least)]
        assert automaton.covers(runs, gap) == plain_cover(words[:cut], templates, least, gap)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_template_is_found_for_itself(spark):
    names, texts = list(L.TEMPLATES), list(L.TEMPLATES.values())
    got = {r.doc_id: r for r in L.licenses(frame(spark, [f"/* some code\n{t}\n*/ and more" for t in texts])).collect()}
    for i, name in enumerate(names):
        labels = set(got[i].labels.split(",")) - {"mit", "apache", "gpl"}
        assert name in labels and got[i].score == 1.0
        assert labels == {name}, (name, labels)


def test_half_of_a_template_and_less(spark):
    words = L.TEMPLATES["mpl-text"].split()
    most, few = " ".join(words[: int(0.7 * len(words))]), " ".join(words[: int(0.3 * len(words))])
    got = {r.doc_id: r for r in L.licenses(frame(spark, [most, few, "", None])).collect()}
    assert got[0].labels == "mpl-text" and got[1].labels == "" and 0 < got[1].score < 0.5 and got[2].score == got[3].score == 0
