"""Numbering rows in a global order without gathering them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir; only where it is unset and all runs on one machine (tests) one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors and driver share no other folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in `order`: range partitions are sorted apart and each adds the rows before it."""
    ensure_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    # One row a partition.
    held = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.expr("coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)")
    held = held.select("_part", "_first", before.alias("_before"))
    return dealt.join(F.broadcast(held), "_part").select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
