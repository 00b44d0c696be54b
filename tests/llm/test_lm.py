from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import lm


def docs():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "The", "the"]
    out = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.choice([1, 5, 80])))) for i in range(120)]
    return [*out, (200, None), (201, ""), (None, "the the w1"), (3, out[3][1])]


def test_scores(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, score double")
    counts = Counter()
    held = [zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in rows]
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            counts.update(lm.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for frequent, block, bits in ((10, 400, 8), (1 << 10, 64 << 20, 8)):
        got = lm.score(df, segments=5, filter_bytes=max(block, 2000), frequent=frequent).collect()
        assert len(got) == len(rows)
        want = sorted((str(d), h, len(lm.tokens_of(t)), sum(counts[w] > 0 for w in lm.tokens_of(t)), n) for (d, t), h in zip(rows, held, strict=True))
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
        base = {str(d): sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in lm.tokens_of(t)) for d, t in rows}
        assert all(abs(r.base_score - base[str(r.doc_id)]) < 1e-6 for r in got)


def test_blocks_add_up(spark):
    df = spark.createDataFrame(docs(), "doc_id bigint, text string")
    one = {(r.doc_id, r.n_tokens): r.score for r in lm.score(df, segments=6).collect()}
    cut = {(r.doc_id, r.n_tokens): r.score for r in lm.score(df, segments=6, filter_bytes=1200).collect()}
    assert one.keys() == cut.keys() and max(abs(one[k] - cut[k]) for k in one) < 1e-6
    assert all(s < 0 for s in one.values())


def plain_scores(rows):
    """The interpolated bigram model from exact counts, quantised as the filter's levels are."""
    words, pairs = Counter(), Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            ts = lm.tokens_of(t)
            words.update(ts)
            pairs.update(zip([ts[-1], *ts], ts, strict=False))
    n, v = sum(words.values()), len(words)

    def about(count):
        if not count:
            return 0.0
        low = 1 << (count.bit_length() - 1)
        return math.sqrt(low * (2 * low - 1))

    out = []
    for d, t in rows:
        ts, total = lm.tokens_of(t), 0.0
        for a, b in zip([ts[-1], *ts], ts, strict=False):
            alone = (about(words[b]) + 1) / (n + v + 1)
            context = about(words[a])
            total += math.log10(0.4 * min(about(pairs[a, b]) / context, 1) + 0.6 * alone if context else alone)
        out.append((str(d), len(ts), total))
    return sorted(out)


@pytest.mark.parametrize("segments, filter_bytes", [(None, 256 << 20), (7, 9000), (7, 1)])
def test_scores_equal_brute_force(spark, segments, filter_bytes):
    """With room enough in the filter, so that no level is overstated; word and bigram filters in one block, in some, and in a block a segment."""
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(df, segments, filter_bytes, bits=400).collect())
    for (d, n, s), (want_d, want_n, want_s) in zip(got, plain_scores(rows), strict=True):
        assert (d, n) == (want_d, want_n) and abs(s - want_s) < 1e-6


def test_full_filter_ends():
    full = lm.Filter.of({0: b"\xff" * 8}, 1, 5)
    assert full.level(np.arange(1, 50, dtype=np.uint64)).tolist() == [5] * 49


def test_ranges_follow_the_tokens():
    assert lm.ranges_for(0) == 8 and lm.ranges_for(10**10) * lm.SEGMENT_BYTES >= 12 * 10**10


def test_filter_never_understates():
    rnd = np.random.default_rng(1)
    hashes = np.unique(rnd.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = rnd.zipf(1.6, len(hashes)).clip(1, 10**6)
    cuts = np.searchsorted(lm.ranges(hashes, 4), np.arange(5))
    whole = lm.Filter.of({r: lm.segment(hashes[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]]).tobytes() for r in range(4)}, 4, int(lm.levels(counts).max()))
    got, want = whole.level(hashes), lm.levels(counts)
    assert (got >= want).all() and (got > want).mean() < 0.06
    other = hashes + np.uint64(1)
    assert (whole.level(other) > 0).mean() < 0.06


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
