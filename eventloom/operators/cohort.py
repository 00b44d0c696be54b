"""Event histories cut at each sample's index time, the birth first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.constants import BIRTH


def births(events: DataFrame) -> DataFrame:
    """(subject_id, birth_t, birth): the first birth row of each subject, combined before the shuffle."""
    attributes = F.struct(*(c for c in events.columns if c not in ("subject_id",)))
    return events.where(F.col("code") == BIRTH).groupBy("subject_id").agg(F.min(F.struct("time", "event_ord", attributes.alias("row"))).alias("b")).select("subject_id", F.col("b.time").alias("birth_t"), F.col("b.row").alias("birth"))


def cohort(events: DataFrame, samples: DataFrame) -> DataFrame:
    """The events of each sample: sample_id, index_t, split, birth_t, ord, n_events and the event's columns.

    samples: (sample_id, subject_id, index_t, split). An event counts up to and including the index time; the first birth
    counts whenever it is and comes first (ord 0), further birth rows do not; samples without a birth are dropped. ord
    follows time, ties event_ord. All windows and later per-sample work share one exchange by sample_id.
    """
    born = births(events)
    named = samples.join(born, "subject_id")
    first = named.select("sample_id", "subject_id", "index_t", "split", "birth_t", "birth.*").withColumn("later", F.lit(0))
    own = events.where(F.col("code") != BIRTH)
    rest = own.join(named.drop("birth"), "subject_id").where(F.col("time") <= F.col("index_t")).withColumn("later", F.lit(1))
    both = first.unionByName(rest).repartition("sample_id")
    by = Window.partitionBy("sample_id")
    out = both.withColumn("ord", F.row_number().over(by.orderBy("later", "time", "event_ord")) - 1)
    return out.withColumn("n_events", F.count(F.lit(1)).over(by)).drop("later")


def last_events(cohort: DataFrame, most: int) -> DataFrame:
    """The last `most` events of each sample; birth_t stays that of the whole history."""
    if most is None:
        return cohort
    return cohort.where(F.col("n_events") - F.col("ord") <= most)


def weighted(cohort: DataFrame, n_samples: int) -> DataFrame:
    """cohort with weight: each sample weighs 1 / n_samples (dropped ones counted), shared by its events."""
    return cohort.withColumn("weight", 1.0 / (F.lit(float(n_samples)) * F.col("n_events")))
