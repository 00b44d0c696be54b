from __future__ import annotations

import random
from functools import cache

import pytest
import sentencepiece

from eventloom.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    rnd = random.Random(4)
    alphabet = "aaaeeetthhinos  rdlcABCÉéüß\n\t𝄞中문  .,!?019___"
    return ["", " ", "  two  spaces ", "Hello  wörld\n\n ab\t 𝄞", "x" * 3000, "ab" * 2000, "    " * 50 + "end", *("".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 3, 10, 200]))) for _ in range(300))]


def test_ids_equal_the_library(library):
    codec = pieces.Codec(pieces.Vocabulary.read())
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert ids.tolist() == library.encode(t), repr(t)
        assert codec.decode(ids) == t


def test_summed_scores_equal_brute_force():
    vocabulary = pieces.Vocabulary.read(merges=False)

    @cache
    def best(word):
        if not word:
            return 0.0
        own = [s + best(word[len(p) :]) for n in range(1, len(word) + 1) if (p := word[:n]) in vocabulary.pieces for s, _ in [vocabulary.pieces[p]]]
        return max([*own, vocabulary.byte_score + best(word[1:])])

    trie = pieces.Trie(vocabulary)
    score = {i: s for s, i in vocabulary.pieces.values()}
    words = sorted({w for t in texts() for w in pieces.words_of(t) if len(w) < 20})
    for w in words:
        ids = memoryview(trie.visit(w)).cast("i").tolist()
        if all(i in score for i in ids):
            assert sum(score[i] for i in ids) == best(w)
    assert trie.steps < sum(map(len, words))  # prefixes were shared


def test_encode_and_decode(spark):
    rows = [(1, "a b", "q"), (1, "a b", "q"), (None, "c ▁d", "q"), (3, None, "q"), (4, "", "q"), (5, "long word " * 30_000, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pieces.encode(df)
    got = out.collect()
    assert len(got) == 6 and all(r.exact for r in got)
    assert all((r.ids is None) == (r.doc_id == 3) and r.n_ids == len(r.ids or []) for r in got)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(out).collect()), key=str)
    assert back == sorted(((d, t and t.replace("▁", " ")) for d, t, _ in rows), key=str)
    assert pieces.encode(df.limit(0)).collect() == []
