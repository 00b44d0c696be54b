"""Weighted moments, value reservoirs, quantile breaks and known stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.values import seconds_between


def age_moments(weighted: DataFrame) -> DataFrame:
    """One row (mean, std): weighted population moments of the seconds since birth, events at the birth left out; zeros without any.

    Two passes, so that ages near 1e9 s don't cancel: the mean is a scalar subquery of the second.
    """
    own = weighted.where(F.col("time") != F.col("birth_t")).select("weight", seconds_between(F.col("birth_t"), F.col("time")).alias("x"))
    mean = own.agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("x")), F.sum("weight")), F.lit(0.0)).alias("mean"))
    apart = own.join(F.broadcast(mean)).select("weight", "mean", ((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("d"))
    spread = apart.agg(F.max("mean").alias("m"), F.sqrt(F.try_divide(F.sum(F.col("weight") * F.col("d")), F.sum("weight"))).alias("s"))
    return spread.select(F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("s", F.lit(0.0)).alias("std"))


def value_key(by_unit: bool) -> Column:
    """code, or code|unit for events with a unit."""
    return F.concat_ws("|", "code", "unit") if by_unit else F.col("code")


MODES = ("first", "uniform", "exact")


def reservoir(cohort: DataFrame, size: int = 1000, by_unit: bool = False, mode: str = "first", seed: int = 0) -> DataFrame:
    """(key, numeric_value): up to `size` values a key, the first in sample and event order, a uniform choice, or (exact) all.

    The rank limit is applied within tasks before the shuffle, so a key moves `size` rows a task at most.
    """
    own = cohort.where(F.col("numeric_value").isNotNull()).withColumn("key", value_key(by_unit))
    if mode == "exact":
        return own.select("key", "numeric_value")
    order = {"first": ["sample_id", "ord"], "uniform": [F.xxhash64(F.lit(seed), "key", "sample_id", "ord"), "sample_id", "ord"]}[mode]
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return ranked.where(F.col("rank") <= size).select("key", "numeric_value")


def breaks_of(values: Column, quantiles: int) -> Column:
    """The values at places floor(i n / q), i from 1 to q - 1, of a sorted array, each once; none if all are equal."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(1), F.lit(quantiles - 1)), lambda i: F.get(values, F.floor(i * n / quantiles).cast("int")))
    same = F.get(values, F.lit(0)) == F.get(values, n - 1)
    empty = F.array().cast("array<double>")
    return F.when((F.lit(quantiles) < 2) | same, empty).otherwise(F.array_distinct(at))


def quantile_breaks(values: DataFrame, quantiles: int = 10) -> DataFrame:
    """(key, breaks array<double>). A reservoir bounds what a key gathers."""
    return values.groupBy("key").agg(F.sort_array(F.collect_list("numeric_value")).alias("v")).select("key", breaks_of(F.col("v"), quantiles).alias("breaks"))


def override_breaks(base: DataFrame, override: DataFrame) -> DataFrame:
    """base with the breaks of override for keys that base has; other keys of override are left out."""
    return base.join(override.select("key", F.col("breaks").alias("new")), "key", "left").select("key", F.coalesce("new", "breaks").alias("breaks"))


def stages(cohort: DataFrame) -> DataFrame:
    """(stage): the distinct lower-case workflow stages."""
    return cohort.where(F.col("workflow_stage").isNotNull()).select(F.lower("workflow_stage").alias("stage")).distinct()
