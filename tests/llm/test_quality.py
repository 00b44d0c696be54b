from __future__ import annotations

import re

import numpy as np

from eventloom.llm import quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, []
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


TEXTS = ["", " \n\t", "a b c", "a a a a a", "x y z x y z\nx y z\nq\nx y z\n\n", "é# 𝄞%% \x85 <a|b>\n \n \n#", "In. " * 60]


def test_base_counts_equal_plain_rules():
    for t in TEXTS:
        assert quality.base_counts(t) == plain_counts(t), t


def test_many_distinct_words():
    ids = np.arange(1 << 21)
    assert quality.repeated_words(np.concatenate([ids + 5, ids[:3] + 5])) == 6


def test_threshold_keeps_trusted():
    scores = [(0.1 * i, True) for i in range(10)] + [(-5.0 - i, False) for i in range(5)]
    assert -5 < quality.least_score(scores) < 0
    assert quality.least_score([(1.0, True)]) == -np.inf


def test_rules(spark):
    good = ["the quick fox %d runs over the lazy dog and sees river %d " % (i, i * 3) for i in range(30)]
    texts = [(g * 8) + " ".join(f"w{i}x{k}" for k in range(150)) for i, g in enumerate(good)] + [" ".join(f"zz%%% qq### {i} ||| vv$$$ k{i}%%%{n}###" for n in range(40)) for i in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (500, None, "x"), (501, "", "x"), (0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, llr string")
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60) if i % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.rules(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 30)
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= 30)
    for r in got:
        if r.doc_id is not None and r.doc_id < 60:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
    none = quality.rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.rules(docs.limit(0), labels).collect() == []


def plain_verdicts(rows, labels):
    """(llr, kept) of each row (doc_id, text), from all labels (doc_id, quality, toxic), in plain loops."""
    worst = {}
    for d, q, t in labels:
        if d is not None and q is not None:
            worst[d] = (min(q, worst.get(d, (q, 0))[0]), max(t or 0, worst.get(d, (0, 0))[1]))
    grams = quality.Grams()
    raw, target = np.full(quality.BUCKETS, 0.5), np.full(quality.BUCKETS, 0.5)
    for d, text in rows:
        for k in grams(text or ""):
            raw[k] += 1
            target[k] += worst.get(d) == (1, 0)
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    llr = [np.mean([weights[k] for k in grams(text or "")]) if text else 0.0 for _, text in rows]
    failed = [n < 50 or 100 * r > 50 * n for n, *_, r in (plain_counts(text or "") for _, text in rows)]
    scores = [(s, worst[d][0] == 1) for (d, _), s, f in zip(rows, llr, failed, strict=True) if not f and d in worst]
    least = plain_least(scores)
    return [(s, not f and s >= least) for s, f in zip(llr, failed, strict=True)]


def plain_least(scores, kept=quality.TRUSTED_KEPT):
    edges, good, bad = sorted({s for s, _ in scores}), [s for s, g in scores if g], [s for s, g in scores if not g]
    best = (-np.inf, -np.inf)
    for low, high in zip(edges, edges[1:]):
        lost = sum(s <= low for s in good) / max(len(good), 1)
        gain = sum(s <= low for s in bad) / max(len(bad), 1) - lost
        if good and bad and lost <= 1 - kept and gain > best[0]:
            best = (gain, (low + high) / 2)
    return best[1]


def corpus():
    """Trusted, bad and unlabelled rows that differ by degrees, with null and repeated ids; labels of some, some of them twice."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        share = rng.random()
        words = [f"good{rng.integers(80)}" if rng.random() < share else f"bad{rng.integers(80)}%" for _ in range(int(rng.integers(40, 120)))]
        rows.append((i if i % 10 else None, " ".join(words)))
    rows += [(3, rows[4][1]), (None, None), (201, "")]
    labels = [(i, int(t.count("good") > t.count("bad")), int(i % 7 == 0)) for i, t in rows[:90] if i is not None and i % 3] + [(1, 0, 0), (2, 1, 1), (None, 1, 0), (5, None, 0)]
    return rows, labels


def same_verdicts(got, rows, labels):
    wanted = sorted(plain_verdicts(rows, labels))
    found = sorted((r.llr, r.kept) for r in got)
    assert len(found) == len(wanted) and len({k for _, k in wanted}) == 2
    assert np.allclose([s for s, _ in found], [s for s, _ in wanted], rtol=0, atol=1e-12)
    assert [k for _, k in found] == [k for _, k in wanted]


def test_all_labels_count(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    others = spark.range(1_000, 101_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    many = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").union(others)
    same_verdicts(quality.rules(docs, many).collect(), rows, labels)


def test_labels_too_many_to_broadcast(spark, monkeypatch):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(quality, "small", lambda df: df)
    same_verdicts(quality.rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect(), rows, labels)


def test_threshold_over_ranges(spark):
    rng = np.random.default_rng(4)
    cases = [[(float(s) / 8, bool(rng.random() < 0.3 + s / 400)) for s in rng.integers(-200, 200, n)] for n in (2, 30, 900)]
    cases += [[], [(1.0, True)], [(1.0, True), (1.0, False)], [(0.0, False), (1.0, True)], [(0.0, True), (1.0, False)], [(-0.0, False), (0.0, True), (2.0, True)]]
    for scores in cases:
        table = spark.createDataFrame(scores, "llr double, good boolean")
        for kept in (0.995, 0.8):
            assert quality.least_of(table, kept) == quality.least_score(scores, kept) == plain_least(scores, kept), (scores[:5], kept)
