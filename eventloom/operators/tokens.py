"""From events to token strings and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import base_code, factorized_tokens, joint_token, quantile_token, stage_token, text_token


def with_parts(
    cohort: DataFrame,
    breaks: DataFrame | None,
    stages: DataFrame | None,
    joint: bool,
    separator: str = "/",
    remove_prefixes: bool = True,
    texts: bool = True,
    emit_stage: bool = True,
    unit_aware: bool = False,
) -> DataFrame:
    """cohort with base, q, txt and stg, an event's parts; each null where the event has none or the part is off.

    breaks: (key, breaks), None for no quantile parts. They are looked up by plain code, so breaks kept by code|unit are only
    found for events without a unit, unless unit_aware. stages: (stage), None if none were collected. Breaks have a row for
    each numeric code, stages one for each distinct label; the optimiser broadcasts them as their measured size allows.
    """
    out = cohort.withColumn("base", base_code(F.col("code"), separator, remove_prefixes))
    if breaks is not None:
        key = F.concat_ws("|", "code", "unit") if unit_aware else F.col("code")
        own = breaks.select(F.col("key").alias("_key"), "breaks")
        out = out.withColumn("_of", key).join(own, F.col("_of") == F.col("_key"), "left").drop("_of", "_key")
        out = out.withColumn("q", quantile_token(F.col("numeric_value"), F.col("breaks"))).drop("breaks")
    else:
        out = out.withColumn("q", F.lit(None).cast("string"))
    out = out.withColumn("txt", text_token(F.col("text_value")) if texts else F.lit(None).cast("string"))
    if not emit_stage:
        return out.withColumn("stg", F.lit(None).cast("string"))
    if stages is None:
        return out.withColumn("stg", stage_token(F.col("workflow_stage"), F.array().cast("array<string>"), joint))
    named = stages.select(F.col("stage").alias("_stage"), F.lit(True).alias("_known"))
    none = stages.isEmpty()
    out = out.withColumn("_lower", F.lower("workflow_stage")).join(named, F.col("_lower") == F.col("_stage"), "left")
    known = F.when(F.col("_known") | F.lit(none and joint), F.array("_lower")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("stg", stage_token(F.col("workflow_stage"), known, False)).drop("_lower", "_stage", "_known")


def joint(separator: str = "/") -> Column:
    return joint_token(F.col("code"), F.col("base"), F.col("q"), F.col("txt"), F.col("stg"), separator)


def factorized() -> Column:
    return factorized_tokens(F.col("code"), F.col("base"), F.col("q"), F.col("txt"), F.col("stg"))


def _ids(vocabulary: DataFrame, column: str, types: tuple[str, ...], cutoff: int | None) -> DataFrame:
    own = vocabulary.where(F.col("type").isin(*types))
    own = own if cutoff is None else own.where(F.col("token_id") < cutoff)
    return own.select(F.col("token").alias(f"_{column}"), F.col("token_id").alias(f"{column}_id"))


def joint_ids(parts: DataFrame, vocabulary: DataFrame, cutoff: int | None = None, separator: str = "/") -> DataFrame:
    """Events whose joint token has an id below the cutoff, with ids, an array of that one."""
    own = parts.withColumn("token", joint(separator))
    return own.join(_ids(vocabulary, "token", ("code",), cutoff), F.col("token") == F.col("_token")).withColumn("ids", F.array("token_id")).drop("_token", "token_id")


def factorized_ids(parts: DataFrame, vocabulary: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Events whose base code has an id, with ids: that and the ids of those other parts that have one.

    No attribute stands without its event: an unknown base code drops the event, an unknown part only itself.
    """
    out = parts.where(F.length("code") > 0)
    out = out.join(_ids(vocabulary, "base", ("code",), cutoff), F.col("base") == F.col("_base"))
    for column, kind in (("q", "quantile"), ("txt", "text"), ("stg", "stage")):
        out = out.join(_ids(vocabulary, column, (kind,), cutoff), F.col(column) == F.col(f"_{column}"), "left")
    ids = F.array_compact(F.array("base_id", "q_id", "txt_id", "stg_id"))
    return out.withColumn("ids", ids).drop(*(f"{p}{c}{s}" for c in ("base", "q", "txt", "stg") for p, s in (("_", ""), ("", "_id"))))
