"""Readers and writers: event shards, samples, token tables, JSON documents, embedding tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schema


def _exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob meets a file, in whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found is not None and len(found))


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All shards of a folder, or of its data/ folder, with typed nulls for absent optional columns.

    event_ord keeps the order of rows within a file and of files by name, which time ties fall back on. Nanosecond times,
    which come as integers under spark.sql.legacy.parquet.nanosAsLong, become microseconds.
    """
    place = next((p for p in (folder, f"{folder}/data") if _exists(spark, f"{p}/{pattern}")), None)
    if place is None:
        raise ValueError(f"no {pattern} in {folder} or {folder}/data")
    df = spark.read.option("pathGlobFilter", pattern).option("mergeSchema", "true").parquet(place)
    df = schema.complete(df.withColumn("event_ord", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))))
    if dict(df.dtypes)["time"] == "bigint":
        df = df.withColumn("time", F.timestamp_micros(F.floor(F.col("time") / 1000)).cast("timestamp_ntz"))
    return df


def read_shards(spark: SparkSession, files: list[str]) -> tuple[list[DataFrame], list[str]]:
    """(usable shards, paths that were skipped because they lack required columns)."""
    shards = {f: spark.read.parquet(f) for f in files}
    return [schema.complete(d) for d in shards.values() if schema.has_required(d)], [f for f, d in shards.items() if not schema.has_required(d)]


def is_reader_format(spark: SparkSession, folder: str) -> bool:
    """Whether a folder has one directory for each of the four event properties and the database's own files."""
    parts = ("code", "description", "numeric_value", "time", "subject_id", "meds_reader.length", "meds_reader.properties", "meds_reader.version")
    return all(_exists(spark, f"{folder}/{p}") for p in parts)


def read_samples(samples: DataFrame, split: str | None = None) -> DataFrame:
    """(sample_id, subject_id, index_t, split): the predicate and projection reach the scan. sample_id orders by subject, then index time."""
    out = samples.where(F.col("split") == split) if split is not None else samples
    label = F.col("split") if "split" in samples.columns else F.lit(None).cast("string")
    own = F.col("sample_id") if "sample_id" in samples.columns else F.struct(F.col("id").cast("bigint").alias("id"), "index_t")
    return out.select(own.alias("sample_id"), F.col("id").cast("bigint").alias("subject_id"), "index_t", label.alias("split"))


def open_dataset(spark: SparkSession, config: dict[str, Any] | Any) -> tuple[DataFrame, DataFrame]:
    """(events, samples) of a config with dataset_path and samples_path, a dict or an object; the config is left as it is."""
    given = dict(config) if isinstance(config, dict) else vars(config)
    for key in ("dataset_path", "samples_path"):
        if not given.get(key):
            raise ValueError(f"the dataset config has no {key}")
    return read_events(spark, given["dataset_path"]), read_samples(spark.read.parquet(given["samples_path"]), given.get("split"))


def write_tokens(sequences: DataFrame, path: str, rows_a_file: int = 32_768) -> None:
    """Zstandard parquet, split into files of at most rows_a_file rows; an empty table writes no rows."""
    sequences.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).mode("errorifexists").parquet(path)


def write_events(events: DataFrame, path: str, order: list[str | Column] | None = None) -> None:
    """Subjects stay together and in time order, ties in event_ord's; no global sort is needed for that."""
    keys = order or ["subject_id", "time", *(c for c in ("event_ord",) if c in events.columns)]
    events.repartition("subject_id").sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def verify_copy(first: DataFrame, second: DataFrame) -> bool:
    """Whether two tables have the same rows, repeats counted."""
    return first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def copy_metadata(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a dataset's metadata folder as it is, in whatever store; False if there is none."""
    if not _exists(spark, f"{source}/metadata"):
        return False
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{p}/metadata") for p in (source, target)]
    conf = spark._jsc.hadoopConfiguration()
    systems = [p.getFileSystem(conf) for p in paths]
    return bool(spark._jvm.org.apache.hadoop.fs.FileUtil.copy(systems[0], paths[0], systems[1], paths[1], False, conf))


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, in whatever store Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_document(spark: SparkSession, path: str) -> Any:
    """A JSON or YAML document, by its ending."""
    kind = path.rpartition(".")[2].lower()
    if kind == "json":
        return json.loads(read_text(spark, path))
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError("YAML documents need the yaml package") from missing
        return yaml.safe_load(read_text(spark, path))
    raise ValueError(f"{path} is neither JSON nor YAML")


def write_document(spark: SparkSession, data: Any, path: str, overwrite: bool = False) -> bool:
    """Writes JSON (infinite bins as Infinity); an existing file stays unless overwrite. Nothing is left if data can't be written."""
    if _exists(spark, path) and not overwrite:
        return False
    write_text(spark, path, json.dumps(data, indent=2))
    return True


def write_representations(df: DataFrame, path: str) -> None:
    """(id string, index_t whole seconds, representations): the columns that consumers read."""
    df.select(F.col("subject_id").cast("string").alias("id"), F.date_trunc("second", "index_t").alias("index_t"), F.col("representation").cast("array<float>").alias("representations")).write.parquet(path)
