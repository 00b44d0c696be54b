"""The event table's shape: required columns, typed nulls for optional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.constants import REQUIRED

OPTIONAL = {
    "description": "string",
    "numeric_value": "double",
    "text_value": "string",
    "unit": "string",
    "visit_id": "bigint",
    "workflow_stage": "string",
    "ref_low": "double",
    "ref_high": "double",
    "embedding_text": "string",
}


def has_required(df: DataFrame) -> bool:
    return all(c in df.columns for c in REQUIRED)


def complete(df: DataFrame) -> DataFrame:
    """df with every optional column, null where it has none; a table without the required columns is refused."""
    if not has_required(df):
        raise ValueError(f"an event table needs {', '.join(REQUIRED)}; it has {', '.join(df.columns)}")
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in df.columns})


def missing(df: DataFrame) -> list[str]:
    return [c for c in (*REQUIRED, *OPTIONAL) if c not in df.columns]
