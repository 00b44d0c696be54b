from __future__ import annotations

import random

import pytest

from eventloom.llm import common, similar, simhash


def jaccard(a, b):
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("bucket, most", [(16, 1_000_000), (2, 0)])
def test_no_similar_documents_stay(spark, monkeypatch, bucket, most):
    monkeypatch.setattr(similar, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rnd = random.Random(3)
    words = [f"wo{i}" for i in range(2000)]
    texts = {}
    for _ in range(8):
        own = rnd.choices(words, k=rnd.randint(60, 200))
        texts[len(texts)] = " ".join(own)
        for edits in (1, 1, 2, 3, 8):
            copy = list(own)
            for at in rnd.sample(range(len(copy)), edits):
                copy[at] = "changed"
            texts[len(texts)] = " ".join(copy)
    docs = [*texts.items(), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, grams string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert out.where("doc_id is null").count() == 1
    close = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    assert len(close) > 20
    assert not [p for p in close if kept.issuperset(p)]
    assert {b for _, b in close} >= texts.keys() - kept
