from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from eventloom.constants import INTERVAL_BINS, demographic_labels, interval_labels, quantile_labels
from eventloom.functions import values

HALF = 15_552_000.0


def test_fixed_labels():
    assert len(interval_labels()) == 13 and len(demographic_labels()) == 46
    assert quantile_labels(3) == ["Q:1", "Q:2", "Q:3", "Q:UNK"]


def test_numeric_features(spark):
    nan, inf = float("nan"), float("inf")
    cases = [
        ((5.0, 4.0, 6.0), [0.5, 1, 0, 1]),
        ((-10.0, 4.0, 6.0), [-2, 1, 0, 1]),
        ((100.0, 4.0, 6.0), [3, 1, 0, 1]),
        ((100.0, None, None), [math.log1p(100) / 7, 0, 1, 1]),
        ((1e10, None, 3.0), [1.5, 0, 1, 1]),
        ((5.0, 4.0, 4.01 - 1e-9), [math.log1p(5) / 7, 0, 1, 1]),
        ((5.0, 4.98, 5.0), [1.0, 1, 0, 1]),
        ((5.0, nan, 6.0), [math.log1p(5) / 7, 0, 1, 1]),
        ((5.0, 1.0, inf), [math.log1p(5) / 7, 0, 1, 1]),
        *(((v, 4.0, 6.0), [0, 0, 0, 0]) for v in (None, nan, inf, -inf)),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "v double, l double, h double")
    got = [r.f for r in df.select(values.numeric_features(F.col("v"), F.col("l"), F.col("h")).alias("f")).collect()]
    for g, (_, w) in zip(got, cases, strict=True):
        assert g == pytest.approx(w)


def test_intervals(spark):
    gaps = [0.0, 299.999, 300.0, 899.0, 900.0, 86_400.0, 7_776_000.0, HALF - 0.5, HALF, HALF + 0.5, HALF + 1.0, HALF * 2.0, HALF * 3 + 10.0, None]
    df = spark.createDataFrame([(g,) for g in gaps], "g double")
    for most in (None, 1, 2):
        for r in df.select("g", values.half_years(F.col("g"), most).alias("n"), values.interval_label(F.col("g")).alias("b")).collect():
            if r.g is None:
                assert (r.n, r.b) == (0, None)
                continue
            n = int((r.g + HALF - 1) // HALF) if r.g >= HALF else 0
            assert r.n == (n if most is None else min(n, most))
            assert r.b == next((x for a, b, x in INTERVAL_BINS if a <= r.g < b), None)


def test_bands(spark):
    year = 31_557_600
    cases = [(-5.0, "0_4"), (0.0, "0_4"), (5.0 * year - 1, "0_4"), (5.0 * year, "5_9"), (99.9 * year, "95_99"), (100.0 * year, "100P")]
    df = spark.createDataFrame([(s,) for s, _ in cases], "s double")
    assert [r.a for r in df.select(values.age_label(F.col("s")).alias("a")).collect()] == [f"DEMO_AGE_{w}" for _, w in cases]
    days = spark.createDataFrame([(datetime.datetime(y, 6, 1),) for y in (1969, 1970, 2004, 2079, 2080)], "t timestamp_ntz")
    assert [r.y for r in days.select(values.year_label(F.col("t")).alias("y")).collect()] == [None, "DEMO_YEAR_1970_1974", "DEMO_YEAR_2000_2004", "DEMO_YEAR_2075_2079", None]


def test_scores(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "w double")
    got = df.select(values.entropy_score(F.col("w")).alias("c"), values.entropy_score(F.col("w"), clamp=False).alias("p")).collect()
    assert got[1].c == got[1].p == pytest.approx(math.log(0.5))
    assert got[0].p is None and got[2].p is None and got[0].c < 0 and got[2].c < 0
    assert df.select(values.age_normalized(F.col("w"), F.lit(0.0), F.lit(0.0)).alias("z")).first().z is None
