from __future__ import annotations

import math
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from eventloom.llm import langid

EN = "the cat and the other animals were walking through the green fields with their friends "
DE = "der hund und die anderen tiere gingen durch die schönen felder über den großen fluss "


def all_segmentations(word, probs, pieces):
    total = 0.0
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            ends = [0, *cuts, len(word)]
            parts = [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            p = 1.0
            for part in parts:
                p *= probs[pieces[part]] if part in pieces else langid.STRANGE if len(part) == 1 else 0.0
            total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "abc", "c"], 1)}
    rnd = np.random.default_rng(3)
    probs = rnd.random((len(pieces) + 1, 2))
    probs[0] = langid.STRANGE
    model = langid.Model(["x", "y"], langid.with_endings(pieces), probs, np.zeros(2), 3)
    words = ["a", "abab", "abcz", "bab", "zz", "abc"]
    got = np.exp(langid.word_scores(words, model))
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([all_segmentations("▁" + w, probs[:, k], pieces) for k in (0, 1)])


def log_sum(word, probs, pieces, longest):
    """The sum over all segmentations with exact fractions of integers."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        lone = word[end - 1]
        total = sums[end - 1] * Fraction(probs[pieces[lone]] if lone in pieces else langid.STRANGE)
        for length in range(2, min(longest, end) + 1):
            if (piece := word[end - length : end]) in pieces:
                total += sums[end - length] * Fraction(probs[pieces[piece]])
        sums.append(total)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


@pytest.mark.parametrize("chunk", [5, 4096])
def test_long_words_are_summed_whole(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "abc", "c", "bcab"], 1)}
    rnd = np.random.default_rng(4)
    probs = rnd.random((len(pieces) + 1, 2)) * 1e-6
    probs[0] = langid.STRANGE
    model = langid.Model(["x", "y"], langid.with_endings(pieces), probs, np.zeros(2), 4)
    words = ["".join(rnd.choice(list("abcz"), n)) for n in (23, 24, 25, 42, 42, 300, 1000)]
    for w, row in zip(words, langid.word_scores(words, model), strict=True):
        assert row == pytest.approx([log_sum("▁" + w, probs[:, k], pieces, 4) for k in (0, 1)])


def test_reversed_lattice_gives_the_same_sum():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "abc", "c"], 1)}
    probs = np.vstack([np.random.default_rng(5).random((len(pieces) + 1, 1)), np.zeros((1, 1))])
    rows = langid.lattice(["▁abab", "▁abcz", "▁zabc"], langid.with_endings(pieces), 3)
    (ahead, logs), (behind, back) = langid.forward(rows, probs), langid.forward(langid._reversed(rows), probs)
    assert np.allclose(ahead[-1] * np.exp(logs[-1]), behind[-1] * np.exp(back[-1]))


def test_expectation_maximisation_raises_likelihood():
    pieces = langid.vocabulary()
    words = {w: 1 + i % 3 for i, w in enumerate((EN + DE).split())}

    def total(probs):
        model = langid.Model(["x"], langid.with_endings(pieces), probs.reshape(-1, 1), np.zeros(1), max(map(len, pieces)))
        return sum(n * s for n, s in zip(words.values(), langid.word_scores(list(words), model)[:, 0], strict=True))

    steps = [total(langid.fit_pieces(words, pieces, r, 1e-9)) for r in (1, 2, 4)]
    assert steps[0] < steps[1] < steps[2]


def rows():
    en, de = EN.split(), DE.split()
    own = [(i, " ".join((en if i % 2 else de)[k % 15] for k in range(i % 5, i % 5 + 9)), "en" if i % 2 else "de") for i in range(120)]
    return [*own, (500, None, "en"), (501, "", "de"), (502, "123 _ ²!", "en"), (503, "Ω", None), (None, "the cat and", None), (3, own[3][1], "en"), (504, "und " * 60_000, None), (505, "the" * 30_000, None)]


def test_identify(spark):
    df = spark.createDataFrame([(*r, 1.0) for r in rows()], "doc_id bigint, text string, lang string, lang_pred double")
    got = langid.identify(df, labelled_docs=40).collect()
    assert len(got) == len(rows())
    want = {d: lang for d, _, lang in rows() if d is not None and d < 120}
    for r in got:
        assert r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id in want:
            assert r.lang_pred == want[r.doc_id]
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[504] == "de" and by[505] == "en" and by[503] in ("de", "en")
    kept = langid.recognised(df, labelled_docs=40)
    assert kept.columns == df.columns and kept.count() == len(rows()) - 3


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the cat", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).collect() == []
