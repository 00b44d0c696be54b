"""Scalar text rules as columns: base codes, normalised text, token strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.constants import UNKNOWN_QUANTILE, UNKNOWN_STAGE, WHITE


def base_code(code: Column, separator: str = "/", remove_prefixes: bool = True) -> Column:
    """The part after the first separator, up to the next; the whole code if there is none or it is empty."""
    if not remove_prefixes:
        return code
    part = F.get(F.split(code, re.escape(separator)), 1)
    return F.when(F.length(part) > 0, part).otherwise(code)


def normalize_text(text: Column) -> Column:
    """Lower case, trimmed, white space runs as one underscore, other marks dropped (Unicode letters and numbers stay); null if nothing is left."""
    trimmed = F.regexp_replace(F.lower(text), rf"\A{WHITE}+|{WHITE}+\z", "")
    joined = F.regexp_replace(trimmed, f"{WHITE}+", "_")
    return F.nullif(F.regexp_replace(joined, r"[^\p{L}\p{N}_]", ""), F.lit(""))


def text_token(text: Column) -> Column:
    return F.concat(F.lit("TXT:"), normalize_text(text))


def quantile_token(value: Column, breaks: Column) -> Column:
    """Q:1 + the number of breaks at or below value; Q:UNK without breaks; NaN reaches none; null without a value."""
    above = F.when(F.isnan(value), F.lit(0)).otherwise(F.size(F.filter(breaks, lambda b: value >= b)))
    known = F.concat(F.lit("Q:"), (above + 1).cast("string"))
    return F.when(value.isNotNull(), F.when(breaks.isNull(), F.lit(UNKNOWN_QUANTILE)).otherwise(known))


def stage_token(stage: Column, known: Column, keep_if_none_known: bool) -> Column:
    """STAGE:<lower case> for a known stage, STAGE:UNK otherwise. With no stages known at all the joint form keeps the stage
    (keep_if_none_known), the factorized form calls it unknown."""
    plain = F.lower(stage)
    member = F.array_contains(known, plain)
    if keep_if_none_known:
        member = member | (F.size(known) == 0)
    return F.when(stage.isNotNull(), F.when(member, F.concat(F.lit("STAGE:"), plain)).otherwise(F.lit(UNKNOWN_STAGE)))


def joint_token(code: Column, base: Column, quantile: Column, text: Column, stage: Column, separator: str = "/") -> Column:
    """One string of the parts that an event has; null without a code."""
    return F.when(F.length(code) > 0, F.concat_ws(separator, base, quantile, text, stage))


def factorized_tokens(code: Column, base: Column, quantile: Column, text: Column, stage: Column) -> Column:
    """The parts as an array, the base code first; null without a code."""
    return F.when(F.length(code) > 0, F.array_compact(F.array(base, quantile, text, stage)))
