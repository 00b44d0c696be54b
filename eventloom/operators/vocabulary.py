"""Vocabularies: weighted frequencies, information scores, numeric bins, sections in fixed order, prepended static tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.constants import UNKNOWN_STAGE, demographic_labels, interval_labels, quantile_labels
from eventloom.functions.text import normalize_text
from eventloom.functions.values import entropy_score
from eventloom.sources.literal import literal

#: Scores closer than this count as equal, then the token decides: sums in parallel differ in their last digits.
DIGITS = 12
FIELDS = "type string, token string, code_string string, text_string string, unit string, val_start double, val_end double, weight double"


def _columns(kind: Column, token: Column, weight: Column, **more: Column) -> list[Column]:
    """All fields of an entry, null but for those given."""
    own = {"type": kind, "token": token, "weight": weight, **more}
    return [own.get(n, F.lit(None)).cast(k).alias(n) for n, k in (f.rsplit(" ", 1) for f in FIELDS.split(", "))]


def ranked(entries: DataFrame, size: int) -> DataFrame:
    """The `size` entries of least score with token_id 0, 1, ...; a top-k, so only `size` rows are ever in one place."""
    order = [F.round("weight", DIGITS), "type", "token"]
    return entries.orderBy(*order).limit(size).withColumn("token_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def token_weights(tokens: DataFrame, column: str = "token") -> DataFrame:
    """(token, w): summed weights."""
    return tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(F.sum("weight").alias("w"))


def joint_vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """The top `size` joint tokens by score. tokens: (token, weight)."""
    scored = token_weights(tokens).withColumn("score", entropy_score(F.col("w")))
    return ranked(scored.select(*_columns(F.lit("code"), F.col("token"), F.col("score"), code_string=F.col("token"))), size)


def static_entries(spark: SparkSession, kind: str, labels: Iterable[str]) -> DataFrame:
    """Entries of fixed labels, in order (place 0, 1, ...), weight -1."""
    rows = literal(spark, [(i, label) for i, label in enumerate(labels)], "place int, label string")
    return rows.select(F.col("place").cast("bigint").alias("place"), *_columns(F.lit(kind), F.col("label"), F.lit(-1.0)))


def factorized_vocabulary(weighted: DataFrame, base: Column, stages: DataFrame | None, size: int, quantiles: int | None = 10, texts: bool = True) -> DataFrame:
    """Sections in order - quantiles, stages and their unknown, texts by score, base codes by score - cut to `size`.

    token_id counts through; num_ntp_classes, the length before the cut, is a column. Static sections are as small as their
    label lists, the scored ones are cut to `size` before they are put in order.
    """
    spark = weighted.sparkSession
    parts = []
    if quantiles is not None:
        parts.append(static_entries(spark, "quantile", quantile_labels(quantiles)).withColumn("section", F.lit(0)))
    if stages is not None:
        # Unbounded stages would be data, not a label set; their order needs no more than the section's top `size`.
        own = stages.select(F.concat(F.lit("STAGE:"), "stage").alias("label"), F.lit(0).alias("last")).unionByName(literal(spark, [(UNKNOWN_STAGE, 1)], "label string, last int"))
        placed = own.orderBy("last", "label").limit(size).withColumn("place", F.row_number().over(Window.orderBy("last", "label")).cast("bigint"))
        parts.append(placed.select("place", *_columns(F.lit("stage"), F.col("label"), F.lit(-1.0))).withColumn("section", F.lit(1)))
    scored = []
    if texts:
        scored.append((2, "text", weighted.where("text_value is not null").withColumn("token", F.concat(F.lit("TXT:"), normalize_text(F.col("text_value"))))))
    scored.append((3, "code", weighted.withColumn("token", base)))
    totals = []
    for section, kind, rows in scored:
        entries = token_weights(rows).select(*_columns(F.lit(kind), F.col("token"), entropy_score(F.col("w"))))
        totals.append(entries.agg(F.count(F.lit(1)).alias("n")))
        parts.append(ranked(entries, size).withColumn("place", F.col("token_id").cast("bigint")).drop("token_id").withColumn("section", F.lit(section)))
    statics = 0 if quantiles is None else len(quantile_labels(quantiles))
    if stages is not None:
        totals.append(stages.agg((F.count(F.lit(1)) + 1).alias("n")))
    everything = totals[0]
    for t in totals[1:]:
        everything = everything.unionByName(t)
    classes = everything.agg((F.sum("n") + statics).alias("num_ntp_classes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.orderBy("section", "place").limit(size).withColumn("token_id", (F.row_number().over(Window.orderBy("section", "place")) - 1).cast("int"))
    return out.drop("section", "place").join(F.broadcast(classes))


def legacy_weights(weighted: DataFrame) -> DataFrame:
    """(type, code, text, unit, w, n): each event counts once, as a number, else as a text, else as a code."""
    kind = F.when(F.col("numeric_value").isNotNull(), "numeric").when(F.col("text_value").isNotNull(), "text").otherwise("code")
    own = weighted.withColumn("type", kind).withColumn("text", F.when(F.col("type") == "text", F.col("text_value")))
    return own.groupBy("type", "code", "text").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))


def numeric_bins(values: DataFrame, weights: DataFrame, bins: int = 10, least: int | None = None) -> DataFrame:
    """(key, bin, val_start, val_end, weight): equal-count bins of each key's values, open at both ends of the line.

    A bin takes ceil(n / bins) values; empty spans are left out, and a key whose every span is empty gets one bin over all
    numbers. values: (key, numeric_value); weights: (key, w), a bin's score is that of w / bins. NaN values are left out.
    """
    held = values.where(~F.isnan("numeric_value")).groupBy("key").agg(F.sort_array(F.collect_list("numeric_value")).alias("v"))
    held = held.withColumn("n", F.size("v")).withColumn("per", F.ceil(F.col("n") / bins).cast("int"))
    if least is not None:
        held = held.where(F.col("n") >= least)
    inf = "double('infinity')"
    spans = F.expr(
        f"filter(transform(filter(sequence(0, {bins - 1}), i -> i = 0 or i * per < n), i -> struct(i as bin, if(i = 0, -{inf}, get(v, i * per)) as val_start,"
        f" if(i = {bins - 1} or (i + 1) * per >= n, {inf}, get(v, (i + 1) * per)) as val_end)), s -> s.val_start != s.val_end)"
    )
    whole = F.expr(f"array(struct(0 as bin, -{inf} as val_start, {inf} as val_end))")
    out = held.withColumn("spans", spans).withColumn("spans", F.when(F.size("spans") > 0, F.col("spans")).otherwise(whole))
    each = out.join(weights, "key").select("key", F.explode("spans").alias("s"), "w")
    return each.select("key", "s.*", entropy_score(F.col("w") / bins, clamp=False).alias("weight"))


def legacy_vocabulary(weighted: DataFrame, values: DataFrame, size: int, bins: int = 10, least: int | None = None) -> DataFrame:
    """The joint vocabulary of codes, (code, text) pairs and numeric bins, by unclamped score."""
    counts = legacy_weights(weighted)
    plain = counts.where("type != 'numeric'")
    plain = plain.select(*_legacy("type", F.col("code"), F.col("text"), F.lit(None), F.lit(None), entropy_score(F.col("w"), clamp=False)))
    numbers = numeric_bins(values, counts.where("type = 'numeric'").select(F.col("code").alias("key"), "w"), bins, least)
    numbers = numbers.select(*_legacy(F.lit("numeric"), F.col("key"), F.lit(None), F.col("val_start"), F.col("val_end"), F.col("weight")))
    both = plain.unionByName(numbers)
    order = [F.round("weight", DIGITS), "type", "code_string", "text_string", "val_start"]
    return both.orderBy(*order).limit(size).withColumn("token_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def _legacy(kind, code, text, start, end, weight) -> list[Column]:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return [kind.alias("type"), code.alias("code_string"), text.cast("string").alias("text_string"), start.cast("double").alias("val_start"), end.cast("double").alias("val_end"), weight.alias("weight")]


def prepended(vocabulary: DataFrame, kind: str, labels: list[str], size: int | None = None) -> DataFrame:
    """vocabulary with the labels it lacks in front, cut to its own length or `size`; token_id is assigned anew.

    The labels go in as a literal table; the shift and the cut are arithmetic on token_id, so the vocabulary is not sorted
    again. A vocabulary is bounded by its size parameter, so it may be broadcast.
    """
    spark = vocabulary.sparkSession
    there = [r.token for r in vocabulary.where((F.col("type") == kind) & F.col("token").isin(labels)).select("token").collect()]
    new = [x for x in labels if x not in there]
    rows = literal(spark, [(i, x) for i, x in enumerate(new)], "token_id int, token string")
    front = rows.select("token_id", *_columns(F.lit(kind), F.col("token"), F.lit(-1.0)))
    back = vocabulary.withColumn("token_id", F.col("token_id") + F.lit(len(new)))
    rest = [c for c in vocabulary.columns if c not in front.columns]
    both = front.withColumns({c: F.lit(None).cast(vocabulary.schema[c].dataType) for c in rest}).unionByName(back)
    return both.where(F.col("token_id") < (vocabulary.count() if size is None else size))


def with_intervals(vocabulary: DataFrame, size: int | None = None) -> DataFrame:
    return prepended(vocabulary, "interval", interval_labels(), size)


def with_demographics(vocabulary: DataFrame, size: int | None = None) -> DataFrame:
    return prepended(vocabulary, "demographic", demographic_labels(), size)


def missing_labels(vocabulary: DataFrame, labels: list[str]) -> DataFrame:
    """(label): required labels that no entry has."""
    want = literal(vocabulary.sparkSession, [(x,) for x in labels], "label string")
    return want.join(vocabulary.select(F.col("token").alias("label")), "label", "left_anti")


def check_labels(vocabulary: DataFrame, labels: list[str]) -> None:
    lacking = [r.label for r in missing_labels(vocabulary, labels).orderBy("label").collect()]
    if lacking:
        raise ValueError(f"the vocabulary lacks {', '.join(lacking)}")

