"""Small tables from the driver whose size the optimiser knows, so that joins with them are broadcast as long as they fit."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def literal(spark: SparkSession, rows: Sequence[Sequence], schema: str | StructType) -> DataFrame:
    """A table of the rows; rows of a plain list of tuples would have no known size and would be joined by shuffles."""
    own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(own.fields)
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, own.fields, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=own.names), own)


def settled(df: DataFrame) -> DataFrame:
    """The rows of a bounded table, computed now, as a literal one."""
    return literal(df.sparkSession, [tuple(r) for r in df.collect()], df.schema)
