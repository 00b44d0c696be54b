"""Scalar number and time rules as columns: ages, intervals, demographic bands, numeric features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.constants import BAND, FIRST_YEAR, HALF_YEAR_SECONDS, INTERVAL_BINS, LAST_YEAR, SECONDS_A_DAY, SECONDS_A_YEAR


def seconds_between(start: Column, end: Column) -> Column:
    """Exact microseconds, as seconds."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def age_days(seconds: Column) -> Column:
    return seconds / F.lit(float(SECONDS_A_DAY))


def age_normalized(seconds: Column, mean: Column, std: Column) -> Column:
    """z-score; null where std is 0, which has no z-scores."""
    return F.try_divide(seconds - mean, std)


def half_years(seconds: Column, most: int | None = None) -> Column:
    """How many half-year tokens a gap takes: rounded up, none below one half year."""
    n = F.floor((seconds + F.lit(HALF_YEAR_SECONDS - 1.0)) / F.lit(float(HALF_YEAR_SECONDS))).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    return F.when(seconds >= HALF_YEAR_SECONDS, n).otherwise(F.lit(0))


def interval_label(seconds: Column) -> Column:
    """The half-open bin a gap falls into; null outside all."""
    return reduce(lambda c, b: c.when((seconds >= b[0]) & (seconds < b[1]), F.lit(b[2])), INTERVAL_BINS[1:], F.when((seconds >= INTERVAL_BINS[0][0]) & (seconds < INTERVAL_BINS[0][1]), F.lit(INTERVAL_BINS[0][2])))


def age_label(seconds: Column) -> Column:
    """Five-year bands of the age in years of 365.25 days; negative ages count as 0, 100 and more are one band."""
    years = F.greatest(F.floor(seconds / F.lit(float(SECONDS_A_YEAR))), F.lit(0))
    low = (F.floor(years / BAND) * BAND).cast("int")
    band = F.concat(F.lit("DEMO_AGE_"), low.cast("string"), F.lit("_"), (low + BAND - 1).cast("string"))
    return F.when(years >= 100, F.lit("DEMO_AGE_100P")).otherwise(band)


def year_label(time: Column) -> Column:
    """Five-year bands of calendar years; null outside the first to the last year."""
    year = F.year(time)
    low = (F.floor((year - FIRST_YEAR) / BAND) * BAND + FIRST_YEAR).cast("int")
    band = F.concat(F.lit("DEMO_YEAR_"), low.cast("string"), F.lit("_"), (low + BAND - 1).cast("string"))
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), band)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def numeric_features(value: Column, low: Column, high: Column) -> Column:
    """array(x, by range, by log, present): the place within a usable reference range, clipped to [-2, 3], or else
    log(1 + |value|) / 7 clipped to [0, 1.5]; zeros without a finite value."""
    ranged = finite(low) & finite(high) & F.coalesce(high - low > 0.01, F.lit(False))
    place = F.least(F.greatest((value - low) / (high - low), F.lit(-2.0)), F.lit(3.0))
    size = F.least(F.greatest(F.log1p(F.abs(value)) / 7.0, F.lit(0.0)), F.lit(1.5))
    one, zero = F.lit(1.0), F.lit(0.0)
    return (
        F.when(~finite(value), F.array(zero, zero, zero, zero))
        .when(ranged, F.array(place, one, zero, one))
        .otherwise(F.array(size, zero, one, one))
    )


def entropy_score(weight: Column, clamp: bool = True) -> Column:
    """w ln w + (1 - w) ln (1 - w); clamped to the open interval, or null at its ends."""
    w = F.least(F.greatest(weight, F.lit(1e-8)), F.lit(1 - 1e-8)) if clamp else F.when((weight > 0) & (weight < 1), weight)
    return w * F.log(w) + (1 - w) * F.log(1 - w)
