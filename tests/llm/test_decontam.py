from __future__ import annotations

import random

import numpy as np

from eventloom.llm import decontam


def plain_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j] - 1, new[-1] - 1, row[j - 1] + (2 if x == y and x > 0 else -1)))
        row = new
        best = max(best, *row)
    return best


def test_alignment_equals_plain_table():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = rnd.integers(0, 5, rnd.integers(1, 20)), rnd.integers(0, 5, rnd.integers(1, 40))
        assert decontam.align(a, b)[0] == plain_align(a.tolist(), b.tolist())


def world():
    rnd = random.Random(6)
    words = [f"wo{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(12, 40)))) for i in range(40)]
    docs = []
    for i in range(200):
        w, kind = rnd.choices(words, k=120), i % 5
        item = items[i % 40][1].split()
        if kind == 0:
            w[50:50] = [x.upper() + "," for x in item]
        elif kind == 1:
            w[50:50] = [x if rnd.random() > 0.12 else "changed" for x in item]
        elif kind == 2:
            w[50:50] = [x for x in item if rnd.random() > 0.1]
        elif kind == 3:
            w[50:50] = item[:4]
        docs.append((i, " ".join(w)))
    return docs, items


def brute(docs, items):
    out = set()
    names = {}
    number = lambda t: [names.setdefault(w, len(names) + 1) for w in decontam.words_of(t)]
    lists = [(i, number(t)) for i, t in items]
    for d, t in docs:
        own = number(t)
        out |= {(d, i) for i, x in lists if x and plain_align(x, own) >= decontam.LEAST_SHARE * 2 * len(x)}
    return out


def test_leaks_equal_brute_force(spark):
    docs, items = world()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0.0) for i in items], "item_id bigint, text string, score double")
    want = brute(docs, items)
    for size in (decontam.BLOCK_BYTES, 2000):
        got = decontam.contaminated(df, bench, size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    whole = {r.doc_id: r for r in got}
    assert docs[0][1][whole[0].start : whole[0].end].lower().replace(",", "") == items[0][1]
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "one two three four"), (4, "ONE two, three four!"), (4, "ONE two, three four!"), (5, "x " * 200_000 + "one two three four")]
    bench = [(7, "one two three four"), (None, "one two three four"), (8, None), (9, "one two"), (10, "")]
    df, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in decontam.contaminated(df, items).collect()), key=str)
    assert got == sorted(((d, i, 1.0) for d in (None, 4, 4, 5) for i in (7, None, 9)), key=str)
    assert decontam.contaminated(df, items.limit(0)).collect() == []
    assert decontam.contaminated(df.limit(0), items).collect() == []
    assert decontam.clean(df, items.limit(0)).count() == 6


def test_edited_copies_are_met_alone_and_beside_exact_ones(spark):
    rnd = random.Random(8)
    words = [f"wo{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=n))) for i, n in enumerate((20, 21, 40, 60, 120, 200) * 2)]
    edited = []
    for i, text in items:
        step = 4 + i % 2
        own = [w if k % step != step - 1 else "changed" for k, w in enumerate(text.split())]
        edited.append((i, " ".join([*rnd.choices(words, k=30), *own, *rnd.choices(words, k=30)])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for copies in (0, 12):
        docs = edited + [(100 + k, text) for k, (_, text) in enumerate(items * copies)]
        want = brute(docs, items)
        assert want >= {(d, d) for d, _ in edited}
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()} == want
        assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_short_items_match_whole():
    index = decontam.Index.of([(1, "Forty-two"), (2, "Yes!"), (3, "?"), (4, None), (5, "two forty")])
    assert decontam.leaks(index, "It is FORTY two, they say; forty two. Yes") == [(0, 1.0, 6, 15), (1, 1.0, 38, 41)]
    assert decontam.leaks(index, "forty and two, yesterday") == []


def test_spans_are_of_the_text_as_it_is():
    index = decontam.Index.of([(1, "one two three four five")])
    assert decontam.leaks(index, "İİİİ zz one two three four five") == [(0, 1.0, 8, 31)]
