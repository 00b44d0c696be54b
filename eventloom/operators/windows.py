"""Windows over sequences: end-anchored starts, labels, positions, dropout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import IGNORED

ARRAYS = ("token_ids", "age", "age_normalized", "embedding_text_ids", "numeric_features")


def starts(length: Column, size: int, stride: int | None = None, one: bool = False) -> Column:
    """Starts of windows of `size`, from the end backwards by `stride`, the last one at 0; only the end's if one."""
    last = F.greatest(length - size, F.lit(0))
    if one:
        return F.array(last)
    return F.array_distinct(F.concat(F.sequence(last, F.lit(0), F.lit(-(stride or size))), F.array(F.lit(0))))


def windows(sequences: DataFrame, size: int, stride: int | None = None, one: bool = False, least: int = 0) -> DataFrame:
    """One row a window: sample_id, window (0, 1, ... in start order of the function above), start, length and slices of the arrays.

    Sequences and windows of fewer than `least` tokens are left out, as are empty ones.
    """
    least = max(least, 1)
    cut = sequences.where(F.col("length") >= least).select("*", F.posexplode(starts(F.col("length"), size, stride, one)).alias("window", "start"))
    cut = cut.withColumn("length", F.least(F.lit(size), F.col("length") - F.col("start"))).where(F.col("length") >= least)
    return cut.withColumns({c: F.slice(c, F.col("start") + 1, F.col("length")) for c in ARRAYS if c in sequences.columns})


def labels(tokens: Column, classes: int | None = None) -> Column:
    """The next token at each place, -100 at the last one and for ids at or above `classes`."""
    following = F.transform(tokens, lambda _, i: F.coalesce(F.get(tokens, i + 1), F.lit(IGNORED)))
    if classes is None:
        return following
    return F.transform(following, lambda t: F.when(t >= classes, F.lit(IGNORED)).otherwise(t))


def positions(windows: DataFrame) -> DataFrame:
    """Ages replaced by places, z-scores by 0."""
    return windows.withColumn("age", F.transform("age", lambda _, i: i.cast("float"))).withColumn("age_normalized", F.transform("age", lambda _: F.lit(0.0).cast("float")))


def chance(seed: int, *parts: Column) -> Column:
    """A fixed number in [0, 1) for each combination of parts, from the first 32 bits of an MD5."""
    text = F.concat_ws("-", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def dropout(windows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each place is dropped with a chance of `share`, from all arrays alike; a window that would lose all keeps all."""
    names = [c for c in ARRAYS if c in windows.columns]
    kept = F.filter(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0))), lambda i: chance(seed, F.col("sample_id"), F.col("start"), i) >= share)
    out = windows.withColumn("_kept", kept).withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.sequence(F.lit(0), F.col("length") - 1)))
    out = out.withColumns({c: _picked(c) for c in names})
    return out.withColumn("length", F.size("_kept")).drop("_kept")


def _picked(column: str) -> Column:
    return F.transform("_kept", lambda i: F.get(F.col(column), i))


def by_position(ages: Column, normalized: Column) -> Column:
    """Whether a sequence holds places instead of ages: two tokens at least, steps of 1, z-scores 0."""
    steps = F.forall(F.sequence(F.lit(1), F.size(ages) - 1), lambda i: F.abs(F.get(ages, i) - F.get(ages, i - 1) - 1) <= 1e-4)
    return F.when(F.size(ages) < 2, F.lit(False)).otherwise(steps & F.forall(normalized, lambda z: z == 0))
