from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text


def one(spark, column, **values):
    kinds = {"v": "double", "b": "array<double>", "k": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("code", "sep", "want"), [("MEDS_BIRTH", "/", "MEDS_BIRTH"), ("LAB/glucose", "/", "glucose"), ("LAB/blood/glucose", "/", "blood"), ("LAB/", "/", "LAB/"), ("LAB|glucose", "|", "glucose"), (None, "/", None), ("", "/", "")])
def test_base_code(spark, code, sep, want):
    assert one(spark, text.base_code(F.col("c"), sep), c=code) == want


def plain(t):
    t = re.sub(r"[^\w_]", "", re.sub(r"\s+", "_", t.lower().strip()))
    return t or None


@pytest.mark.parametrize("t", ["  oral  ", "oral (by mouth)", "IV/SC", "oral    route", "@#$%", "", "café Ünder x", "a\x1cb \x85", "ß²½ Ⅷ", "中 文_x", "ÀÉ-Ô"])
def test_normalize_text(spark, t):
    assert one(spark, text.normalize_text(F.col("t")), t=t) == plain(t)


@pytest.mark.parametrize(("v", "b", "want"), [(60.0, [70.0, 85.0, 100.0, 120.0], "Q:1"), (70.0, [70.0, 85.0, 100.0, 120.0], "Q:2"), (150.0, [70.0, 85.0, 100.0, 120.0], "Q:5"), (5.0, None, "Q:UNK"), (5.0, [], "Q:1"), (float("nan"), [1.0], "Q:1"), (float("inf"), [1.0], "Q:2"), (None, [1.0], None)])
def test_quantile_token(spark, v, b, want):
    assert one(spark, text.quantile_token(F.col("v"), F.col("b")), v=v, b=b) == want


@pytest.mark.parametrize(("k", "keep", "want"), [(["order"], True, "STAGE:order"), (["taken"], True, "STAGE:UNK"), ([], True, "STAGE:order"), ([], False, "STAGE:UNK")])
def test_stage_token(spark, k, keep, want):
    assert one(spark, text.stage_token(F.col("s"), F.col("k"), keep), s="Order", k=k) == want


def test_joint_and_factorized(spark):
    cols = [F.col(c) for c in ("c", "p", "q", "t", "s")]
    values = {"c": "DRUG/metformin", "p": "metformin", "q": None, "t": "TXT:oral", "s": "STAGE:order"}
    assert one(spark, text.joint_token(*cols), **values) == "metformin/TXT:oral/STAGE:order"
    assert one(spark, text.factorized_tokens(*cols), **values) == ["metformin", "TXT:oral", "STAGE:order"]
    assert one(spark, text.joint_token(*cols), **(values | {"c": ""})) is None
