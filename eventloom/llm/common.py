"""What the text operators share: session folders, vectorised maps over whole texts, gapless numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.order import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def steady(df: DataFrame) -> DataFrame:
    """df if its rows come in the same order whenever a partition is computed again, as those of files do; cut if it is shuffled."""
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def release(*dfs: DataFrame | None) -> None:
    """Deletes what cut wrote for these tables, once nothing that is still to run reads them: disk follows what is in use."""
    for df in dfs:
        if df is not None:
            path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if path.isDefined():
                delete(df.sparkSession, path.get())


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: A table of short rows (names, places) is broadcast up to this many rows, joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it is measured to have no more than `most` rows (BROADCAST_ROWS)."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns: whatever else a table carries can't clash with an operator's own columns."""
    return df.select(*(df[n] for n in names))


#: Bytes of text that a worker splits into words at a time.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of at most `most` bytes of text; a longer text is alone in one."""
    for b in batches:
        if b.num_rows < 2 or "text" not in b.schema.names:
            yield b
            continue
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < b.num_rows:
            within = int(np.searchsorted(np.cumsum(sizes[start:]), most, side="right"))
            yield b.slice(start, max(1, within))
            start += max(1, within)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices: Spark cuts its input batches by bytes, and the slices bound what a worker has split into words.

    Workers outlive their tasks, so what a task has freed goes back to the system at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(slices(batches))
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def in_split(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold: crc32 of the id as text, modulo folds. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def numbered(df: DataFrame, order: list[Column], by: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with a bigint column `name`: 0, 1, 2, ... within each value of `by`, in the given order.

    A window over `by` would put a value's rows into one task. Here rows are range-partitioned by (by, order), cut to the
    checkpoint folder, and each partition adds the number of rows that earlier partitions hold for its values. The table of
    those counts has at most one row for each partition and value that meet, so partitions + values rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_by", by)
    dealt = cut(keyed.repartitionByRange(n, F.col("_by"), *order).sortWithinPartitions(F.col("_by"), *order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    held = dealt.groupBy("_by", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = "coalesce(sum(_n) over (partition by _by order by _part rows between unbounded preceding and 1 preceding), 0)"
    held = held.select("_by", "_part", "_first", F.expr(before).alias("_before"))
    out = dealt.join(held.withColumnsRenamed({"_by": "_b", "_part": "_p"}), F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
