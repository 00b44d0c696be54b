from __future__ import annotations

import random

import pytest

from eventloom.llm import common, lines

ODD = "abcé𝄞"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(line, rnd):
    out = list(line)
    for _ in range(rnd.choice([0, 1, 1, 2, 3])):
        i, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out[i] = rnd.choice(ODD)
        elif kind == 1:
            out.insert(i, rnd.choice(ODD))
        else:
            del out[i]
    return "".join(out)


def brute(docs, edits, least):
    """Texts after removing lines that are not the first of their class, over (id, text) with distinct ids."""
    own = [(d, k, x) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")) if x]
    distinct = sorted({x for _, _, x in own})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    for d, k, x in own:
        first[find(x)] = min(first.get(find(x), (d, k)), (d, k))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x or first[find(x)] == (d, k)) for d, t in docs}


def some_lines(rnd, n=30):
    return ["".join(rnd.choice("abc déf𝄞") for _ in range(rnd.randint(18, 30))) for _ in range(n)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton_equals_edit_distance(spark, edits):
    rnd = random.Random(edits)
    base = some_lines(rnd)
    pairs = [(a, edited(a, rnd)) for a in rnd.choices(base, k=150)] + [(rnd.choice(base), rnd.choice(base)) for _ in range(30)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within_edits("a", "b", edits).alias("w")).collect()
    assert all(r.w == (distance(r.a, r.b) <= edits) for r in got)


@pytest.mark.parametrize("edits", [1, 2])
def test_dedup_equals_brute_force(spark, edits):
    rnd = random.Random(9)
    base = some_lines(rnd)
    docs = [(i, None if i % 13 == 5 else "\n".join(["", "short"] * (i % 3) + [edited(rnd.choice(base), rnd) for _ in range(5)])) for i in range(80)] + [(900, ""), (901, "\n\n")]
    df = spark.createDataFrame([(*d, "x", 7, "y", "z") for d in docs], "doc_id bigint, text string, line string, removed_lines int, gone string, row string")
    out = lines.dedup(df, edits, 20)
    assert out.columns == ["doc_id", "text", "line", "gone", "row", "text_lines", "removed_lines", "near_lines"]
    got = {r.doc_id: r for r in out.collect()}
    want = brute(docs, edits, 20)
    assert {d: r.text for d, r in got.items()} == want
    for d, t in docs:
        assert got[d].text_lines == (0 if t is None else t.count("\n") + 1)
        assert got[d].removed_lines == (0 if t is None else t.count("\n") - want[d].count("\n") + (want[d] == "" and t != "" and got[d].removed_lines == got[d].text_lines))


def test_crowded_bucket_without_pairs(spark):
    rnd = random.Random(2)
    base = "q" * 5 + "".join(rnd.choice("abcdefg") for _ in range(17))
    own = [(k, c) for k in (2, 15, 16, 20) for c in "hijklmnopqrstuvwxyzABCDEFGH"]
    docs = [(i, base[:k] + c + base[k + 1 :] + ("x" if i % 5 == 0 else "")) for i, (k, c) in enumerate(own)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), 1, 20).collect()}
    assert got == brute(docs, 1, 20)


def test_repeated_rows_null_ids_and_long_lines(spark):
    long = "z" * 60_000
    docs = [(4, "the very same line of text\nown line number four here"), (4, "the very same line of text\nown line number four here"), (None, "the very same line of text"), (5, long), (6, long + "y")]
    got = sorted(((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(4, "own line number four here"), (4, "own line number four here"), (None, "the very same line of text"), (5, long), (6, "")], key=str)


def test_texts_under_one_id_are_told_apart(spark):
    docs = [(4, "a line that only this text has\nboth"), (4, "both\nanother line, in the other text"), (None, "both"), (None, "none but this")]
    got = sorted(r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert got == sorted(["a line that only this text has", "another line, in the other text", "both", "none but this"])


def test_without_repeats_keeps_the_columns(spark):
    docs = [(1, "one line\ntwo lines", 7, "a", 1.5), (2, "two lines", 7, "b", 2.5), (3, "three\none line", 7, "c", 3.5), (4, None, 0, "d", None), (5, "", 9, "e", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars int, text_lines string, removed_lines double")
    out = lines.without_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == [docs[0], (3, "three", 5, "c", 3.5), docs[3], docs[4]]
    assert lines.without_repeats(df.limit(0)).collect() == []


def test_tables_beyond_the_broadcast_bound(spark, monkeypatch):
    rnd = random.Random(4)
    base = some_lines(rnd)
    docs = [(i, "\n".join(edited(rnd.choice(base), rnd) for _ in range(5))) for i in range(40)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(docs, 1, 20)


def test_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
