from __future__ import annotations

import random

import pytest
import xxhash

from eventloom.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, root string, e string"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], prints[i], least.get(find(i))) for i, r in enumerate(rows)), key=str)


def texts():
    rnd = random.Random(3)
    words = ["alpha", "Beta", "γάμμα", "delta", "É", "zeta", "eta\x85x", "iota"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 9, 40, 300]))) for _ in range(40)]
    out = [None, "", " \t\n", "One", "one two", "ONE two", *base, *base[:10]]
    for b in base:
        ws = b.split(" ")
        for _ in range(4):
            ws[rnd.randrange(len(ws))] = rnd.choice(words)
            out.append("  ".join(ws))
    return out


@pytest.mark.parametrize("wide", [1, 64])
def test_components_equal_brute_force(spark, wide):
    rows = [(None if i % 17 == 3 else (i * 7919) % 1009, t) for i, t in enumerate(texts())]
    rows += rows[5:9]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = simhash.near_copies(df, wide).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == brute(rows)


def test_fingerprint_of_long_text():
    text = "Aa bB cc " * 70_000
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_chain_of_links_and_crowded_bucket(spark):
    prints = [0, 3, 15, 63, 255, *(1 << 40 | 1 << b for b in range(33, 63)), 2**63 - 1]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    for wide in (2, 64):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, wide), "a", "b").collect()}
        assert len({roots[p] for p in prints[:5]}) == 1
        assert len({roots[p - (1 << 64) if p >= 1 << 63 else p] for p in prints[5:-1]}) == 1


def test_one_of_each(spark):
    docs = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (2, "another text"), (None, "a b c d"), (None, "no id"), (None, "no id"), (9, "q r s t u v"), (11, None), (10, "")]
    df = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], "doc_id bigint, text string, at int, row string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "a b c d"), (2, "another text"), (9, "q r s t u v"), (10, ""), (None, "no id")], key=str)
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_empty_table(spark):
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
