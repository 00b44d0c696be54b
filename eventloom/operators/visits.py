"""Timestamp repair: events recorded at a visit's start that belong to its end."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import END_STAGE, MOVED_PREFIXES, START_STAGE, VISIT_PATTERN


def visit_times(events: DataFrame, pattern: str = VISIT_PATTERN, start: str = START_STAGE, end: str = END_STAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """(visit_id, visit_start, visit_end) of visits that have both: the earliest start and the latest end event.

    One pass: both come from one aggregation by visit_id (and `by`, such as a file name, to keep visits apart).
    """
    stage = F.lower("workflow_stage")
    at = lambda s: F.when(stage == s.lower(), F.col("time"))
    own = events.where(F.col("code").rlike(pattern) & F.col("visit_id").isNotNull() & stage.isin(start.lower(), end.lower()))
    return own.groupBy(*by, "visit_id").agg(F.min(at(start)).alias("visit_start"), F.max(at(end)).alias("visit_end")).where("visit_start is not null and visit_end is not null")


def has_prefix(prefixes: tuple[str, ...] = MOVED_PREFIXES, description: bool = True) -> Column:
    """Whether the code, or the description, begins with one of the prefixes; a null one does not veto the other."""
    columns = ["code", "description"] if description else ["code"]
    return reduce(or_, [F.coalesce(F.col(c).startswith(p), F.lit(False)) for c in columns for p in prefixes], F.lit(False))


def move_to_visit_end(events: DataFrame, prefixes: tuple[str, ...] = MOVED_PREFIXES, check_description: bool = True, by: tuple[str, ...] = (), flag: bool = False, **visit) -> DataFrame:
    """events with the time of those that match a prefix and sit exactly at their visit's start set to its end.

    A table without workflow_stage, visit_id or code is returned unchanged. An end before the start moves times backwards,
    as recorded. Sorting is left to the writer; flag=True adds `moved`, true where the time changed.
    """
    if not {"workflow_stage", "visit_id", "code", "time"} <= {*events.columns}:
        return events
    times = visit_times(events, by=by, **visit)
    joined = events.join(times, [*by, "visit_id"], "left")
    hit = has_prefix(prefixes, check_description and "description" in events.columns) & (F.col("time") == F.col("visit_start"))
    out = joined.withColumn("moved", F.coalesce(hit & (F.col("visit_end") != F.col("time")), F.lit(False)))
    out = out.withColumn("time", F.when(hit, F.col("visit_end")).otherwise(F.col("time")))
    return out.select(*events.columns, *(["moved"] if flag else []))


def transform_chain(events: DataFrame, stages: list) -> DataFrame:
    """Applies DataFrame functions one after another."""
    return reduce(lambda df, stage: df.transform(stage), stages, events)
