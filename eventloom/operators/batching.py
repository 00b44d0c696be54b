"""Batches under a token budget, collated flat."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from eventloom.constants import IGNORED
from eventloom.operators.windows import chance


def shuffled_order(seed: int, *keys: str) -> list[Column]:
    """A fixed permutation: by a hash of the keys, ties by the keys."""
    return [chance(seed, *(F.col(k) for k in keys)), *(F.col(k) for k in keys)]


#: Windows that one shard holds where the number of shards is left to the data.
SHARD_WINDOWS = 100_000


def packed(windows: DataFrame, budget: int, least: int = 1, seed: int = 0, shards: int | None = 1, drop_last: bool = False) -> DataFrame:
    """(shard, batch, place, sample_id, start, length): windows in shuffled order, greedily put into batches.

    A batch is closed before a window that would exceed the budget, if it has `least` windows by then; a short tail is
    dropped only on request. The greedy rule is a fold over lengths in order, so it runs within shards, dealt by the sample:
    an integer modulo `shards`, anything else (a struct of id and index time, say) by its hash. shards=None takes as many as
    the counted windows need. Four numbers a window are sorted and passed once, in time linear in the windows and without
    gathering a shard.
    """
    if shards is None:
        shards = max(1, -(-windows.count() // SHARD_WINDOWS))
    whole = isinstance(windows.schema["sample_id"].dataType, IntegralType)
    dealt = F.col("sample_id") if whole else F.xxhash64("sample_id")
    items = windows.select(F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"), "sample_id", "start", "length", chance(seed, F.col("sample_id"), F.col("start")).alias("r"))
    order = items.repartition("shard").sortWithinPartitions("shard", "r", "sample_id", "start", "length").drop("r")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, batch, total, place = None, 0, 0, 0
        for b in batches:
            numbers, places = [], []
            for own, length in zip(b.column("shard").to_pylist(), b.column("length").to_pylist(), strict=True):
                if own != shard:
                    shard, batch, total, place = own, 0, 0, 0
                elif total + length > budget and place >= least:
                    batch, total, place = batch + 1, 0, 0
                numbers.append(batch)
                places.append(place)
                total, place = total + length, place + 1
            cols = [b.column("shard"), pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), *(b.column(c) for c in ("sample_id", "start", "length"))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "batch", "place", "sample_id", "start", "length"])

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in ("sample_id", "start", "length"))
    out = order.mapInArrow(fill, f"shard int, batch int, place int, {kinds}")
    if drop_last:
        last = F.col("batch") == F.max("batch").over(Window.partitionBy("shard"))
        out = out.withColumn("tail", last & (F.count(F.lit(1)).over(Window.partitionBy("shard", "batch")) < least)).where("not tail").drop("tail")
    return out


def with_offsets(batches: DataFrame) -> DataFrame:
    """batches with last_index: where each window's last token stands in its batch's flat token array."""
    by = Window.partitionBy("shard", "batch").orderBy("place")
    return batches.withColumn("last_index", F.sum("length").over(by) - 1)


def collated(batches: DataFrame, windows: DataFrame) -> DataFrame:
    """One row a batch: flat input_ids, ages, normalized_ages, the windows' lengths, and the labelled places with their labels.

    windows: sample_id, start, token_ids, age, age_normalized, labels. A batch is bounded by the token budget.
    """
    own = batches.drop("length").join(windows, ["sample_id", "start"])
    item = F.struct("place", "sample_id", "index_t", "token_ids", "age", "age_normalized", "labels", "length")
    rows = own.groupBy("shard", "batch").agg(F.array_sort(F.collect_list(item)).alias("w"))
    flat = lambda name: F.flatten(F.transform("w", lambda x: x[name]))
    rows = rows.withColumn("_labels", flat("labels"))
    places = F.filter(F.sequence(F.lit(0), F.size("_labels") - 1), lambda i: F.get("_labels", i) != IGNORED)
    return rows.select(
        "shard",
        "batch",
        flat("token_ids").alias("input_ids"),
        flat("age").alias("ages"),
        flat("age_normalized").alias("normalized_ages"),
        F.transform("w", lambda x: x["length"]).alias("patient_lengths"),
        places.alias("label_indices"),
        F.filter("_labels", lambda x: x != IGNORED).alias("labels"),
        F.transform("w", lambda x: x["sample_id"]).alias("sample_ids"),
        F.transform("w", lambda x: F.unix_micros(x["index_t"].cast("timestamp")) / 1e6).alias("index_times"),
    )


def eval_subset(windows: DataFrame, batches: int, budget: int, seed: int = 0) -> DataFrame:
    """The first windows in shuffled order whose running total stays below `batches` budgets.

    Every window has a token, so batches * budget windows in that order hold the answer: a top-k, then a running sum over it.
    """
    order = shuffled_order(seed, "sample_id", "start")
    head = windows.orderBy(*order).limit(batches * budget)
    total = F.sum("length").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return head.withColumn("_total", total).where(F.floor(F.col("_total") / budget) < batches).drop("_total")
