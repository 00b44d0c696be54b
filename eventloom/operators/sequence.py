"""From events with ids to sequences: gaps as interval tokens, demographic prefixes, ages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.constants import BIRTH, FEMALE_CODES, HALF_YEAR, HALF_YEAR_SECONDS, MALE_CODES, UNKNOWN_CODES
from eventloom.functions.values import age_days, age_label, age_normalized, half_years, interval_label, seconds_between, year_label

SAMPLE = ("sample_id", "subject_id", "index_t")


def _labels(vocabulary: DataFrame, kind: str, cutoff: int | None) -> DataFrame:
    """(label, id): at most as many rows as the kind has fixed labels."""
    own = vocabulary.where(F.col("type") == kind)
    own = own if cutoff is None else own.where(F.col("token_id") < cutoff)
    return F.broadcast(own.select(F.col("token").alias("label"), F.col("token_id").alias("id")))


def with_gaps(known: DataFrame, start: Column | None = None) -> DataFrame:
    """Events in the vocabulary, with prev_t and gap seconds to the event before among them; `start` stands before the first."""
    own = Window.partitionBy("sample_id").orderBy("ord")
    before = F.lag("time").over(own)
    out = known.withColumn("prev_t", before if start is None else F.coalesce(before, start))
    return out.withColumn("gap", seconds_between(F.col("prev_t"), F.col("time")))


def with_intervals(gaps: DataFrame, vocabulary: DataFrame, most: int | None = None, cutoff: int | None = None) -> DataFrame:
    """gaps with half_n, the number of half-year tokens, half_id, and bin_label and bin_id of what the gap leaves over.

    Half years are rounded up and only counted if their token has an id; the rest is looked up among the bins, so bins follow
    half years only where `most` caps these. Gaps below the first bin give nothing.
    """
    labels = _labels(vocabulary, "interval", cutoff)
    half = labels.where(F.col("label") == HALF_YEAR).select("label", F.col("id").alias("half_id"))
    out = gaps.withColumn("_half", F.lit(HALF_YEAR)).join(half, F.col("_half") == F.col("label"), "left").drop("_half", "label")
    out = out.withColumn("half_n", F.when(F.col("half_id").isNotNull(), F.coalesce(half_years(F.col("gap"), most), F.lit(0))).otherwise(0))
    out = out.withColumn("bin_label", interval_label(F.col("gap") - F.col("half_n") * HALF_YEAR_SECONDS))
    return out.join(labels.select(F.col("label").alias("_bin"), F.col("id").alias("bin_id")), F.col("bin_label") == F.col("_bin"), "left").drop("_bin")


def event_tokens(events: DataFrame) -> Column:
    """An event's tokens in order, each with its age in seconds: half years at their own ages, then the bin and the event's ids."""
    age = seconds_between(F.col("birth_t"), F.col("time"))
    item = lambda token, at: F.struct(token.cast("int").alias("token"), at.alias("age"))
    own = F.transform("ids", lambda i: item(i, age))
    if "half_n" not in events.columns:
        return own
    since = seconds_between(F.col("birth_t"), F.col("prev_t"))
    halves = F.when(F.col("half_n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("half_n", F.lit(1))), lambda k: item(F.col("half_id"), F.least(since + k * HALF_YEAR_SECONDS, age))))
    bins = F.when(F.col("bin_id").isNotNull(), F.array(item(F.col("bin_id"), age)))
    none = F.array().cast("array<struct<token:int,age:double>>")
    return F.concat(F.coalesce(halves, none), F.coalesce(bins, none), own)


def assembled(events: DataFrame, age_stats: DataFrame, prefix: DataFrame | None = None) -> DataFrame:
    """One row a sample: sample_id, subject_id, index_t, token_ids, age, age_normalized (float arrays), length.

    Only (ord, tokens) structs are gathered, a subject's lifetime at most, on the exchange by sample that the windows used.
    With a prefix, (sample_id, prefix array<int>), its tokens come first and ages become places, z-scores 0. Samples of
    which no event is known come out with empty arrays if `events` has none of theirs only through the prefix.
    """
    rows = events.select(*SAMPLE, F.struct("ord", event_tokens(events).alias("items")).alias("e"))
    own = rows.groupBy(*SAMPLE).agg(F.flatten(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["items"])).alias("items"))
    if prefix is not None:
        own = prefix.join(own.drop("subject_id", "index_t"), "sample_id", "left")
        ids = F.concat("prefix", F.coalesce(F.transform("items", lambda x: x["token"]), F.array().cast("array<int>")))
        own = own.withColumn("token_ids", ids).withColumn("age", F.transform("token_ids", lambda _, i: i.cast("float")))
        own = own.withColumn("age_normalized", F.transform("token_ids", lambda _: F.lit(0.0).cast("float")))
    else:
        own = own.join(F.broadcast(age_stats)).withColumn("token_ids", F.transform("items", lambda x: x["token"]))
        own = own.withColumn("age", F.transform("items", lambda x: age_days(x["age"]).cast("float")))
        own = own.withColumn("age_normalized", F.transform("items", lambda x: age_normalized(x["age"], F.col("mean"), F.col("std")).cast("float")))
    return own.select(*SAMPLE, "token_ids", "age", "age_normalized", F.size("token_ids").alias("length"))


def leading_run(cohort: DataFrame, male: Sequence[str] = MALE_CODES, female: Sequence[str] = FEMALE_CODES, unknown: Sequence[str] = UNKNOWN_CODES) -> DataFrame:
    """One row a sample: sex_label, first_ord and first_t of the first event that is neither birth nor a sex code.

    The last male or female code before that event gives the label. Codes that say unknown are passed over only as long as no
    sex is known; after one, such a code is an event.
    """
    sex = F.when(F.col("code").isin(*male), "DEMO_SEX_MALE").when(F.col("code").isin(*female), "DEMO_SEX_FEMALE")
    own = cohort.select(*SAMPLE, "ord", "time", "code", "birth_t", sex.alias("sex"))
    passed = (F.col("code") == BIRTH) | F.col("sex").isNotNull()
    if unknown:
        before = Window.partitionBy("sample_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        passed = passed | (F.col("code").isin(*unknown) & (F.coalesce(F.count("sex").over(before), F.lit(0)) == 0))
    own = own.withColumn("passed", passed)
    first = own.groupBy(*SAMPLE, "birth_t").agg(
        F.min(F.when(~F.col("passed"), F.struct("ord", "time"))).alias("first"), F.sort_array(F.collect_list(F.when(F.col("sex").isNotNull(), F.struct("ord", "sex")))).alias("sexes")
    )
    last = F.filter("sexes", lambda s: F.coalesce(s["ord"] < F.col("first.ord"), F.lit(True)))
    label = F.when(F.size(last) > 0, F.get(last, F.size(last) - 1)["sex"]).otherwise("DEMO_SEX_UNKNOWN")
    return first.select(*SAMPLE, "birth_t", F.col("first.ord").alias("first_ord"), F.col("first.time").alias("first_t"), label.alias("sex_label"))


def demographic_prefix(run: DataFrame, vocabulary: DataFrame, include_year: bool = False, cutoff: int | None = None) -> DataFrame:
    """run with age_label, year_label, prefix (array<int>) and skip_reason, null for samples that are kept."""
    labels = _labels(vocabulary, "demographic", cutoff)
    out = run.withColumn("age_label", age_label(seconds_between(F.col("birth_t"), F.col("first_t")))).withColumn("year_label", year_label(F.col("first_t")))
    names = ["sex_label", "age_label", *(["year_label"] if include_year else [])]
    for n in names:
        out = out.join(labels.select(F.col("label").alias(f"_{n}"), F.col("id").alias(f"{n}_id")), F.col(n) == F.col(f"_{n}"), "left").drop(f"_{n}")
    lacking = F.lit(False)
    for n in names:
        lacking = lacking | F.col(f"{n}_id").isNull()
    reason = F.when(F.col("first_ord").isNull(), "no_medical_events_after_birth_or_sex")
    if include_year:
        reason = reason.when(F.col("year_label").isNull(), "first_event_year_out_of_range")
    out = out.withColumn("skip_reason", reason.when(lacking, "missing_demographic_token"))
    return out.withColumn("prefix", F.array(*(f"{n}_id" for n in names))).drop(*(f"{n}_id" for n in names))


def skip_counts(prefixed: DataFrame) -> DataFrame:
    return prefixed.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
