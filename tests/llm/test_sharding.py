from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from eventloom.llm import sharding


def plain_best_fit(sizes, capacity):
    rooms, where = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        i = min(fits)[1] if fits else len(rooms)
        if i == len(rooms):
            rooms.append(capacity)
        rooms[i] -= s
        where.append((s, i))
    return where


def test_packing_equals_plain_best_fit():
    rnd = random.Random(1)
    for n in (1, 5, 200):
        sizes = [rnd.choice([1, 2, 7, 30, 31, rnd.randint(1, 90)]) for _ in range(n)]
        got = [(s, b) for s, b, k in sharding.best_fit_decreasing(list(Counter(sizes).items()), 97) for _ in range(k)]
        assert sorted(got) == sorted(plain_best_fit(sizes, 97))
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(5, 1)], 4)


def test_tree_stays_balanced():
    bins = sharding.Bins(1000)
    for size in range(500, 0, -1):
        bins.place(size, 3)
    assert bins.root.height <= 1.45 * (len(bins.rooms) + 2).bit_length()


def rows():
    rnd = random.Random(2)
    own = [(i, rnd.choice(["é" * 5, "tiny"]) if i % 3 == 0 else "x" * rnd.randint(0, 400) + str(i)) for i in range(600)]
    return [*own, (700, None), (701, ""), (None, "null id"), (5, own[5][1])]


@pytest.mark.parametrize("shards", [1, 24])
def test_shards(spark, shards):
    df = spark.createDataFrame([(*r, 3, "y") for r in rows()], "doc_id bigint, text string, shard int, gid string")
    got = sharding.pack(df, shards=shards).collect()
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert set(sizes) == set(range(shards))
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    limit = sum(sizes.values()) / shards
    total = Counter()
    for r in got:
        total[r.text_crc32, r["size"]] += r["size"]
    assert all(len(homes[g]) == 1 for g in homes if total[g] <= limit)


def test_heavy_text_under_null_and_repeated_ids(spark):
    """2,000 equal texts without id, 2,000 under one id, and 100 small ones: all shards fill alike."""
    docs = [(None, "y" * 100)] * 2000 + [(7, "z" * 90)] * 2000 + [(i, f"small {i}") for i in range(100)]
    got = sharding.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), shards=24).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(docs) and set(sizes) == set(range(24))
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_capacity_and_empty(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    got = sharding.pack(df, capacity=5000).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 5000 and len(sizes) <= 1.1 * sum(sizes.values()) / 5000 + 1
    assert sharding.pack(df.limit(0), shards=24).collect() == []
    with pytest.raises(ValueError):
        sharding.pack(df)
