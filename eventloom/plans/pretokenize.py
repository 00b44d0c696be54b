"""The plans from events to token sequences and embedding rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.constants import FEMALE_CODES, MALE_CODES, UNKNOWN_CODES, demographic_labels, interval_labels
from eventloom.operators import cohort as cohorts
from eventloom.operators import embedding, sequence, tokens, vocabulary
from eventloom.plans.training import Trained, key_column, parts


def known_events(cohort: DataFrame, trained: Trained, cutoff: int | None = None) -> DataFrame:
    """Events with ids, by the vocabulary's mode."""
    own = parts(cohort, trained.breaks, trained.stages, trained.settings)
    if trained.settings.mode == "joint":
        return tokens.joint_ids(own, trained.vocabulary, cutoff, trained.settings.separator)
    return tokens.factorized_ids(own, trained.vocabulary, cutoff)


def with_half_and_bins(known: DataFrame, trained: Trained, most: int | None, cutoff: int | None, start=None) -> DataFrame:
    return sequence.with_intervals(sequence.with_gaps(known, start), trained.vocabulary, most, cutoff)


def sequences(
    events: DataFrame,
    samples: DataFrame,
    trained: Trained,
    intervals: bool = False,
    max_interval_repeat: int | None = None,
    demographics: bool = False,
    include_year: bool = False,
    max_events: int | None = None,
    cutoff: int | None = None,
    sex_codes: tuple[Sequence[str], Sequence[str], Sequence[str]] = (MALE_CODES, FEMALE_CODES, UNKNOWN_CODES),
) -> tuple[DataFrame, DataFrame | None]:
    """(sequences, skip reasons): one row a kept sample; with demographics, why the others were skipped.

    sex_codes are the codes that say male, female and unknown. Unknown events are dropped before gaps are taken. Samples whose events are all unknown keep a row with empty arrays.
    """
    if demographics and max_events is not None:
        raise ValueError("max_events keeps the last events, which leaves out the birth and sex codes that demographics need")
    if intervals:
        vocabulary.check_labels(trained.vocabulary, interval_labels())
    if demographics:
        vocabulary.check_labels(trained.vocabulary, [x for x in demographic_labels() if include_year or not x.startswith("DEMO_YEAR_")])
    own = cohorts.cohort(events, samples)
    prefix = skipped = None
    start = None
    if demographics:
        prefix = sequence.demographic_prefix(sequence.leading_run(own, *sex_codes), trained.vocabulary, include_year, cutoff)
        skipped = prefix.select(*sequence.SAMPLE, "skip_reason")
        prefix = prefix.where("skip_reason is null")
        own = own.join(prefix.select("sample_id", "first_ord", "first_t"), "sample_id").where(F.col("ord") >= F.col("first_ord"))
        start = F.col("first_t")
    elif max_events is not None:
        own = cohorts.last_events(own, max_events)
    known = known_events(own, trained, cutoff)
    if intervals:
        known = with_half_and_bins(known, trained, max_interval_repeat, cutoff, start)
    if demographics:
        return sequence.assembled(known, trained.age_stats, prefix.select(*sequence.SAMPLE, "prefix")), skipped
    out = sequence.assembled(known, trained.age_stats)
    # Every sample with a birth has an event, so those without a known one are found without the cohort.
    born = samples.join(cohorts.births(events).select("subject_id"), "subject_id").select(*sequence.SAMPLE)
    empty = born.join(out.select("sample_id"), "sample_id", "left_anti")
    none = {"token_ids": "array<int>", "age": "array<float>", "age_normalized": "array<float>"}
    return out.unionByName(empty.select(*sequence.SAMPLE, *(F.array().cast(k).alias(n) for n, k in none.items()), F.lit(0).alias("length"))), skipped


def embedding_rows(events: DataFrame, samples: DataFrame, trained: Trained, texts: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Rows of the embedding branch; labels always follow the joint policy, whatever the vocabulary's mode."""
    s = trained.settings
    own = tokens.with_parts(cohorts.cohort(events, samples), trained.breaks, trained.stages, True, s.separator, s.remove_prefixes, s.emit_text, s.emit_stage, s.unit_aware)
    return embedding.rows(own, texts, trained.vocabulary, key_column(trained), trained.age_stats, cutoff)
