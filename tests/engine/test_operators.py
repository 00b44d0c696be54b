"""Operators on tiny tables, against literal expectations and a row-at-a-time checker."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventloom import schema
from eventloom.constants import HALF_YEAR, INTERVAL_BINS, demographic_labels, interval_labels
from eventloom.operators import batching, cohort, embedding, model, sequence, statistics, visits, vocabulary, windows
from eventloom.plans import pretokenize, training
from eventloom.sources import events as files

DAY = datetime.timedelta(days=1)
T0 = datetime.datetime(2000, 1, 1)
EVENTS = "subject_id bigint, time timestamp_ntz, code string, numeric_value double, text_value string, workflow_stage string, unit string, event_ord bigint, embedding_text string, ref_low double, ref_high double"


def events(spark, rows):
    """rows: (subject, time, code, value, text, stage); event_ord is their place."""
    full = [(s, t, c, v, x, w, None, i, None if c == "none" else c, None, None) for i, (s, t, c, v, x, w) in enumerate(rows)]
    return schema.complete(spark.createDataFrame(full, EVENTS))


def samples(spark, rows):
    return files.read_samples(spark.createDataFrame(rows, "sample_id bigint, id bigint, index_t timestamp_ntz, split string"))


def doc(codes, mode="factorized", **config):
    labels = [{"type": "quantile", "label": x} for x in ("Q:1", "Q:2", "Q:3", "Q:UNK")] + [{"type": "stage", "label": x} for x in ("STAGE:order", "STAGE:UNK")]
    return {"vocab": [*labels, *({"type": "code", "code_string": c} for c in codes)], "age_stats": {"mean": 0.0, "std": 86400.0}, "config": {"tokenization_mode": mode, "num_quantiles": 3, **config}, "quantile_breaks": {"LAB/glucose": [100.0, 150.0]}, "discovered_stages": ["order"]}


def rows_of(df):
    return {r.sample_id: r for r in df.collect()}


def test_factorized_ids_and_no_orphans(spark):
    own = [(1, T0, "MEDS_BIRTH", None, None, None), (1, T0 + DAY, "LAB/glucose", 80.0, None, None), (1, T0 + 2 * DAY, "LAB/glucose", 120.0, None, None), (1, T0 + 3 * DAY, "DX/diabetes", None, None, None), (2, T0, "MEDS_BIRTH", None, None, None), (2, T0 + DAY, "LAB/unknown", 100.0, None, "order")]
    trained = training.load(spark, doc(["MEDS_BIRTH", "glucose", "diabetes"]))
    cut = samples(spark, [(10, 1, T0 + 9 * DAY, "a"), (20, 2, T0 + 9 * DAY, "a")])
    got = rows_of(pretokenize.sequences(events(spark, own), cut, trained)[0])
    assert got[10].token_ids == [6, 7, 0, 7, 1, 8]
    assert got[20].token_ids == [6]
    assert got[10].age == [0, 1, 1, 2, 2, 3] and got[10].age_normalized == got[10].age and got[10].length == 6


def test_cohort_pins_birth_and_cuts(spark):
    own = [
        (1, T0 + 5 * DAY, "MEDS_BIRTH", None, None, None),
        (1, T0 + 6 * DAY, "MEDS_BIRTH", None, None, None),
        (1, T0 + DAY, "A", None, None, None),
        (1, T0 + 2 * DAY, "B", None, None, None),
        (1, T0 + 2 * DAY, "C", None, None, None),
        (1, T0 + 2 * DAY + DAY / 1000, "D", None, None, None),
        (3, T0, "E", None, None, None),
    ]
    cut = samples(spark, [(1, 1, T0 + 2 * DAY, "a"), (2, 1, T0, "a"), (3, 3, T0, "a"), (4, 99, T0, "a")])
    got = cohort.cohort(events(spark, own), cut).orderBy("sample_id", "ord").collect()
    assert [(r.sample_id, r.ord, r.code, r.n_events) for r in got] == [(1, 0, "MEDS_BIRTH", 4), (1, 1, "A", 4), (1, 2, "B", 4), (1, 3, "C", 4), (2, 0, "MEDS_BIRTH", 1)]
    last = cohort.last_events(cohort.cohort(events(spark, own), cut), 2).where("sample_id = 1").orderBy("ord").collect()
    assert [r.code for r in last] == ["B", "C"] and last[0].birth_t == T0 + 5 * DAY


def plain_tokens(own, ids, halves, most):
    """The interval rules, event by event, over known events (time, id)."""
    birth, before, out = own[0][0], None, []
    seconds = lambda d: d.total_seconds()
    for t, i in own:
        if i is None:
            continue
        if before is not None:
            gap = seconds(t - before)
            if gap >= 300:
                if halves is not None and gap >= 15_552_000:
                    n = int((gap + 15_552_000 - 1) // 15_552_000)
                    n = n if most is None else min(n, most)
                    out += [(halves, min(seconds(before - birth) + (k + 1) * 15_552_000, seconds(t - birth))) for k in range(n)]
                    gap -= n * 15_552_000
                out += [(ids[label], seconds(t - birth)) for a, b, label in INTERVAL_BINS if a <= gap < b and label in ids]
        out.append((i, seconds(t - birth)))
        before = t
    return out


@pytest.mark.parametrize("most", [None, 1, 2])
def test_intervals_equal_plain_rules(spark, most):
    rnd = random.Random(7)
    rows, want = [], {}
    names = ["MEDS_BIRTH", "A", "B"]
    order = [*interval_labels(), *names]
    ids = {x: i for i, x in enumerate(order)}
    for s in range(25):
        t, own = T0, [(T0, ids["MEDS_BIRTH"])]
        rows.append((s, T0, "MEDS_BIRTH", None, None, None))
        for _ in range(12):
            t += datetime.timedelta(seconds=rnd.choice([0, 60, 300, 899.5, 4000, 90_000, 600_000, 9e6, 15_552_000, 4e7, 2e8]))
            code = rnd.choice(["A", "B", "none"])
            rows.append((s, t, code, None, None, None))
            own.append((t, ids.get(code)))
        want[s] = plain_tokens(own, ids, ids[HALF_YEAR], most)
    vocab = {"vocab": [{"type": "interval", "label": x} for x in interval_labels()] + [{"type": "code", "code_string": x} for x in names], "age_stats": {"mean": 0.0, "std": 1.0}}
    trained = training.load(spark, vocab)
    cut = samples(spark, [(s, s, T0 + 99_999 * DAY, "a") for s in range(25)])
    got = rows_of(pretokenize.sequences(events(spark, rows), cut, trained, intervals=True, max_interval_repeat=most)[0])
    for s, w in want.items():
        assert got[s].token_ids == [i for i, _ in w]
        assert got[s].age == pytest.approx([a / 86400 for _, a in w], rel=1e-6)


def demographics(spark, rows, **more):
    vocab = {"vocab": [{"type": "demographic", "label": x} for x in demographic_labels()] + [{"type": "code", "code_string": "A"}], "age_stats": {"mean": 1.0, "std": 2.0}}
    cut = samples(spark, [(s, s, T0 + 99_999 * DAY, "a") for s in sorted({r[0] for r in rows})])
    return pretokenize.sequences(events(spark, rows), cut, training.load(spark, vocab), demographics=True, **more)


def test_demographic_prefix(spark):
    labels = demographic_labels()
    rows = [(1, T0, "MEDS_BIRTH", None, None, None), (1, T0, "8532", None, None, None), (1, T0, "8507", None, None, None), (1, T0 + 30 * DAY, "A", None, None, None), (1, T0 + 31 * DAY, "8532", None, None, None), (1, T0 + 32 * DAY, "A", None, None, None)]
    rows += [(2, T0, "MEDS_BIRTH", None, None, None), (2, T0, "8507", None, None, None)]
    rows += [(3, datetime.datetime(1950, 1, 1), "MEDS_BIRTH", None, None, None), (3, datetime.datetime(1960, 1, 1), "A", None, None, None)]
    out, skipped = demographics(spark, rows, include_year=True)
    got = rows_of(out)
    assert set(got) == {1}
    assert [labels[i] for i in got[1].token_ids[:3]] == ["DEMO_SEX_MALE", "DEMO_AGE_0_4", "DEMO_YEAR_2000_2004"]
    assert got[1].token_ids[3:] == [46, 46] and got[1].age == [0, 1, 2, 3, 4] and got[1].age_normalized == [0] * 5
    assert {r.sample_id: r.skip_reason for r in skipped.collect()} == {1: None, 2: "no_medical_events_after_birth_or_sex", 3: "first_event_year_out_of_range"}
    run = rows_of(sequence.leading_run(cohort.cohort(events(spark, [(1, T0, "MEDS_BIRTH", None, None, None), (1, T0, "U", None, None, None), (1, T0, "8507", None, None, None), (1, T0, "U", None, None, None), (1, T0, "A", None, None, None)]), samples(spark, [(1, 1, T0 + DAY, "a")])), unknown=("U",)))
    assert (run[1].first_ord, run[1].sex_label) == (3, "DEMO_SEX_MALE")
    with pytest.raises(ValueError):
        demographics(spark, rows, max_events=3)
    with pytest.raises(ValueError):
        demographics(spark, rows, intervals=True)


def test_visit_end_move(spark):
    start, end = T0 + datetime.timedelta(hours=8), T0 + 2 * DAY
    rows = [(7, start, "VISIT/IP", "Start", None), (7, end, "VISIT/IP", "END", None), (7, start, "DIAGNOSIS/flu", None, None), (7, start, "X", None, "PROCEDURE/p"), (7, start, "LAB/g", None, None), (7, start + DAY / 2, "DIAGNOSIS/x", None, None), (8, start, "VISIT/IP", "start", None), (8, start, "DIAGNOSIS/y", None, None), (None, start, "DIAGNOSIS/z", None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "subject_id bigint, visit_id bigint, time timestamp_ntz, code string, workflow_stage string, description string")
    got = {(r.visit_id, r.code): (r.time, r.moved) for r in visits.move_to_visit_end(df, flag=True).collect()}
    assert got[7, "DIAGNOSIS/flu"] == got[7, "X"] == (end, True)
    for key in ((7, "LAB/g"), (8, "DIAGNOSIS/y"), (None, "DIAGNOSIS/z")):
        assert got[key] == (start, False)
    assert got[7, "DIAGNOSIS/x"][0] == start + DAY / 2
    plain = {(r.visit_id, r.code): r.time for r in visits.move_to_visit_end(df, check_description=False).collect()}
    assert plain[7, "X"] == start
    assert visits.move_to_visit_end(df.drop("visit_id")).columns == df.drop("visit_id").columns


@pytest.mark.parametrize(("values", "q", "want"), [([5, 5, 5], 4, []), ([1, 2, 3], 1, []), ([60, 80, 100, 120, 140, 160], 3, [100, 140]), ([0, 0, 0, 100], 5, [0, 100])])
def test_quantile_breaks(spark, values, q, want):
    df = spark.createDataFrame([("k", float(v)) for v in values], "key string, numeric_value double")
    assert statistics.quantile_breaks(df, q).first().breaks == want


def test_reservoirs(spark):
    df = spark.createDataFrame([(1, i, "A", float(i), "mg" if i % 2 else None) for i in range(50)], "sample_id bigint, ord int, code string, numeric_value double, unit string")
    assert sorted(r.numeric_value for r in statistics.reservoir(df, 5).collect()) == [0, 1, 2, 3, 4]
    assert statistics.reservoir(df, 5, mode="exact").count() == 50
    chosen = [sorted(r.numeric_value for r in statistics.reservoir(df, 5, mode="uniform", seed=s).collect()) for s in (1, 1, 2)]
    assert len(chosen[0]) == 5 and chosen[0] == chosen[1] != chosen[2]
    assert {r.key for r in statistics.reservoir(df, 5, by_unit=True).collect()} == {"A", "A|mg"}


def test_weighted_moments(spark):
    df = spark.createDataFrame([(T0, T0 + datetime.timedelta(seconds=x), w) for x, w in ((10, 3.0), (20, 1.0), (0, 9.0))], "birth_t timestamp_ntz, time timestamp_ntz, weight double")
    r = statistics.age_moments(df).first()
    assert r["mean"] == pytest.approx(12.5) and r["std"] == pytest.approx((0.75 * 2.5**2 + 0.25 * 7.5**2) ** 0.5)
    assert tuple(statistics.age_moments(df.limit(0)).first()) == (0.0, 0.0)


def sequences(spark, lengths):
    rows = [(i, i, T0, list(range(n)), [float(100 * k) for k in range(n)], [0.5] * n, n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "sample_id bigint, subject_id bigint, index_t timestamp_ntz, token_ids array<int>, age array<float>, age_normalized array<float>, length int")


def test_windows_labels_positions(spark):
    own = sequences(spark, [20, 3, 0, 8])
    got = windows.windows(own, 8)
    starts = {}
    for r in got.orderBy("window").collect():
        starts.setdefault(r.sample_id, []).append((r.start, r.length, r.token_ids))
    assert [s for s, _, _ in starts[0]] == [12, 4, 0] and [n for _, n, _ in starts[0]] == [8, 8, 8]
    assert starts[1] == [(0, 3, [0, 1, 2])] and 2 not in starts and len(starts[3]) == 1
    assert windows.windows(own, 8, one=True, least=5).count() == 2
    df = spark.createDataFrame([([0, 50, 8200, 100, 8500],), ([0],)], "t array<int>")
    assert [r.l for r in df.select(windows.labels(F.col("t"), 8192).alias("l")).collect()] == [[50, -100, 100, -100, -100], [-100]]
    placed = windows.positions(got).where("sample_id = 1").first()
    assert placed.age == [0, 1, 2] and placed.age_normalized == [0, 0, 0]
    assert [r.b for r in windows.positions(windows.windows(own, 8, one=True)).orderBy("sample_id").select(windows.by_position(F.col("age"), F.col("age_normalized")).alias("b")).collect()] == [True, True, True]


def test_dropout(spark):
    own = windows.windows(sequences(spark, [8, 1, 5]), 8)
    for r in windows.dropout(own, 0.5, 3).collect():
        assert r.length == len(r.token_ids) == len(r.age) > 0 and [100.0 * i for i in r.token_ids] == r.age
    assert [r.length for r in windows.dropout(own, 1.0, 3).orderBy("sample_id").collect()] == [8, 1, 5]
    assert [r.length for r in windows.dropout(own, 0.0, 3).orderBy("sample_id").collect()] == [8, 1, 5]


def test_batches(spark):
    own = windows.windows(sequences(spark, [i % 5 + 1 for i in range(20)]), 8).withColumn("labels", windows.labels(F.col("token_ids")))
    cut = batching.packed(own, 10, 2, seed=4)
    by = {}
    for r in batching.with_offsets(cut).orderBy("batch", "place").collect():
        by.setdefault(r.batch, []).append(r)
    total, n, batch = 0, 0, 0
    for b in sorted(by):
        for r in by[b]:
            if total + r.length > 10 and n >= 2:
                total, n, batch = 0, 0, batch + 1
            assert batch == b
            total, n = total + r.length, n + 1
        assert [r.last_index for r in by[b]] == [sum(x.length for x in by[b][: k + 1]) - 1 for k in range(len(by[b]))]
    assert sum(map(len, by.values())) == 20
    named = own.withColumn("sample_id", F.struct(F.col("sample_id").alias("id"), F.lit("2020-01-01").cast("timestamp_ntz").alias("index_t")))
    for shards in (1, 3, None):
        dealt = batching.packed(named, 10, 2, seed=4, shards=shards).collect()
        assert sorted(r.sample_id.id for r in dealt) == sorted(r.sample_id for r in own.collect())
        sizes = {}
        for r in dealt:
            sizes.setdefault((r.shard, r.batch), []).append((r.place, r.length))
        assert all([p for p, _ in sorted(x)] == list(range(len(x))) for x in sizes.values())
        assert all(sum(n for _, n in x) <= 10 or len(x) <= 2 for x in sizes.values())
    assert batching.collated(batching.packed(named, 10, 2, seed=4), named).count() == len(by)
    flat = batching.collated(cut, own)
    for r in flat.collect():
        assert len(r.input_ids) == sum(r.patient_lengths) == len(r.ages) and len(r.label_indices) == len(r.labels)
    few = batching.packed(own, 10, 9, seed=4, drop_last=True)
    assert few.count() <= 20
    assert batching.eval_subset(own, 0, 100).count() == 0
    big = windows.windows(sequences(spark, [1000]), 1000)
    assert batching.eval_subset(big, 1, 100).count() == 0


def test_vocabularies(spark):
    own = [(s, T0 + k * DAY, c, v, x, w) for s in (1, 2) for k, (c, v, x, w) in enumerate([("MEDS_BIRTH", None, None, None), ("LAB/g", 1.0, None, "Order"), ("LAB/g", 2.0, " A b", None), ("DRUG/m", None, "A b", "taken")])]
    ev, cut = events(spark, own), samples(spark, [(1, 1, T0 + 9 * DAY, "a"), (2, 2, T0 + 9 * DAY, "a")])
    made = training.fit(ev, cut, training.Settings(mode="factorized", vocab_size=11, quantiles=2))
    tokens = [r.token for r in made.vocabulary.orderBy("token_id").collect()]
    assert tokens[:7] == ["Q:1", "Q:2", "Q:UNK", "STAGE:order", "STAGE:taken", "STAGE:UNK", "TXT:a_b"] and set(tokens[7:]) == {"MEDS_BIRTH", "g", "m"}
    assert made.vocabulary.first().num_ntp_classes == 10
    joint = training.fit(ev, cut, training.Settings(vocab_size=5, quantiles=2))
    back = training.load(spark, training.document(joint))
    assert [r.token for r in back.vocabulary.orderBy("token_id").collect()] == [r.token for r in joint.vocabulary.orderBy("token_id").collect()]
    a, b = (rows_of(pretokenize.sequences(ev, cut, t)[0]) for t in (joint, back))
    assert a == b
    more = vocabulary.with_intervals(vocabulary.with_demographics(joint.vocabulary, 200), 200).orderBy("token_id").collect()
    assert [r.token for r in more[:59]] == [*interval_labels(), *demographic_labels()] and len(more) == 59 + joint.vocabulary.count()
    kept = vocabulary.with_intervals(joint.vocabulary)
    assert kept.count() == joint.vocabulary.count()
    again = vocabulary.with_intervals(vocabulary.with_intervals(joint.vocabulary, 50), 50)
    assert again.where("type = 'interval'").count() == 13
    with pytest.raises(ValueError):
        vocabulary.check_labels(joint.vocabulary, interval_labels())
    with pytest.raises(ValueError):
        training.Settings(mode="none")


def test_embedding_branch(spark):
    own = [(1, T0, "MEDS_BIRTH", None, None, None), (1, T0 + DAY, "LAB/glucose", 5.0, None, None), (1, T0 + 2 * DAY, "none", 5.0, None, None), (2, T0, "none", None, None, None)]
    ev = events(spark, own).withColumn("ref_low", F.lit(4.0)).withColumn("ref_high", F.lit(6.0))
    texts = embedding.text_ids(embedding.unique_texts(ev))
    assert {r.embedding_text: r.embedding_text_id for r in texts.collect()} == {"LAB/glucose": 0, "MEDS_BIRTH": 1}
    trained = training.load(spark, doc(["MEDS_BIRTH"]))
    got = embedding.assembled(pretokenize.embedding_rows(ev, samples(spark, [(1, 1, T0 + 9 * DAY, "a")]), trained, texts)).collect()
    assert len(got) == 1 and got[0].embedding_text_ids == [1, 0] and got[0].token_ids == [6, -100] and got[0].age == [0, 1]
    assert got[0].numeric_features[1] == [0.5, 1, 0, 1]
    table = embedding.encode_texts(texts, embedding.hash_encoder(4))
    vectors = {r.embedding_text: r.embedding for r in table.collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-2 for v in vectors.values())
    wanted = spark.createDataFrame([("MEDS_BIRTH",), ("lost",)], "embedding_text string")
    assert embedding.lookup(table, wanted).count() == 2
    with pytest.raises(KeyError):
        embedding.lookup(table, wanted, strict=True)


def test_model_parts(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (10.0,), (0.0,)], "age double")
    got = [r.r for r in df.select(model.rope(F.col("age"), 8).alias("r")).collect()]
    assert got[0] == got[1] != got[2] and all((x["sin"], x["cos"]) == (0, 1) for x in got[3])
    a = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]], [[1.0], [3.0]]), (2, [[9.0, 9.0]], [[9.0, 9.0]], [[7.0]])], "sample_id bigint, q array<array<double>>, k array<array<double>>, v array<array<double>>")
    out = {r.sample_id: r.out for r in model.block_attention(a).collect()}
    assert out[1][0] == [1.0] and 1 < out[1][1][0] < 3 and out[2] == [[7.0]]
    narrow = {r.sample_id: r.out for r in model.block_attention(a, 1).collect()}
    assert narrow[1] == [[1.0], [3.0]]
    x = spark.createDataFrame([([1.0, 2.0],)], "x array<float>")
    y = model.mlp(x, "x", ([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[1.0, 1.0]], [0.5]), "y").first().y
    assert y[0] == pytest.approx(0.8413 + 1.9545 + 0.5, abs=1e-3)
    n = spark.createDataFrame([([3.0, 4.0],)], "x array<double>").select(model.rms_norm(F.col("x"), eps=0.0).alias("n")).first().n
    assert n == pytest.approx([3 / 12.5**0.5, 4 / 12.5**0.5])
