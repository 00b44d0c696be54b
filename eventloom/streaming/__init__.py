"""Event counts over an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours", base=None) -> DataFrame:
    """(window_start, code, n, total) for streaming or static events of (time timestamp, code, numeric_value); late rows up to `late` still count."""
    code = F.col("code") if base is None else base
    own = events.withColumn("t", F.col("time").cast("timestamp")).withWatermark("t", late)
    return own.groupBy(F.window("t", window).alias("w"), code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("numeric_value").alias("total")).select(F.col("w.start").alias("window_start"), "code", "n", "total")


def stream_tables(spark, folder: str, schema) -> DataFrame:
    """Event shards as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
