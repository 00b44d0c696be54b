"""The embedding branch: text ids, set hashes, encoders, rows of ids, labels and numeric features."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import IGNORED
from eventloom.functions.values import age_days, age_normalized, numeric_features, seconds_between
from eventloom.operators.order import numbered
from eventloom.operators.sequence import SAMPLE


def unique_texts(events: DataFrame, column: str = "embedding_text") -> DataFrame:
    """(embedding_text): distinct non-null texts; an empty text counts."""
    return events.select(F.col(column).alias("embedding_text")).where("embedding_text is not null").distinct()


def text_ids(texts: DataFrame) -> DataFrame:
    """(embedding_text, embedding_text_id): 0, 1, ... in code point order, which is the order of UTF-8 bytes."""
    return numbered(texts, [F.col("embedding_text")], "embedding_text_id").withColumn("embedding_text_id", F.col("embedding_text_id").cast("int"))


def string_set_hash(texts: DataFrame) -> str:
    """SHA-256 over the sorted texts, each followed by a zero byte; sorted texts stream through, partition by partition."""
    digest = hashlib.sha256()
    for row in texts.orderBy("embedding_text").toLocalIterator():
        digest.update(row.embedding_text.encode() + b"\0")
    return digest.hexdigest()


def hash_encoder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a text encoder: unit vectors drawn from each text's digest."""

    def encode(texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return encode


def encode_texts(ids: DataFrame, encode: Callable[[list[str]], list[list[float]]], half: bool = True, batch: int = 512) -> DataFrame:
    """(embedding_text_id, embedding_text, embedding array<float>) by any encoder of lists of texts; half rounds through 16 bits."""

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].copy()
                vectors = np.asarray(encode(part["embedding_text"].tolist()), np.float16 if half else np.float32).astype(np.float32)
                part["embedding"] = [v.tolist() for v in vectors]
                yield part

    return ids.select("embedding_text_id", "embedding_text").mapInPandas(run, "embedding_text_id int, embedding_text string, embedding array<float>")


def write_lookup(table: DataFrame, path: str, **metadata: Any) -> None:
    """The table as parquet and one line of JSON about it, both through Spark's writers."""
    spark = table.sparkSession
    table.write.parquet(f"{path}/table")
    own = {"n_embeddings": spark.read.parquet(f"{path}/table").count(), "string_set_hash": string_set_hash(table.select("embedding_text")), **metadata}
    spark.createDataFrame([(json.dumps(own, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def lookup(table: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """wanted(embedding_text, ...) with ids and vectors; strict refuses texts that the table lacks."""
    out = wanted.join(table, "embedding_text", "left")
    if strict and not (lost := out.where("embedding_text_id is null").limit(1)).isEmpty():
        raise KeyError(lost.first().embedding_text)
    return out


def gather(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(sample_id, pos, embedding_text_id, embedding) for rows of (sample_id, embedding_text_ids)."""
    each = ids.select("sample_id", F.posexplode("embedding_text_ids").alias("pos", "embedding_text_id"))
    return each.join(vectors, "embedding_text_id")


def rows(tokens: DataFrame, texts: DataFrame, vocabulary: DataFrame, token: Column, age_stats: DataFrame, cutoff: int | None = None) -> DataFrame:
    """One row an event with a known text: text id, label (its joint token's id, or -100), features and ages.

    Events without a known text are left out; gaps and ages don't depend on them. texts: (embedding_text, embedding_text_id).
    """
    own = vocabulary.where(F.col("type") == "code")
    own = own if cutoff is None else own.where(F.col("token_id") < cutoff)
    named = own.select(F.col("token").alias("_token"), F.col("token_id").alias("_id"))
    out = tokens.join(texts, "embedding_text").withColumn("token", token).join(named, F.col("token") == F.col("_token"), "left")
    since = seconds_between(F.col("birth_t"), F.col("time"))
    out = out.withColumn("label", F.coalesce("_id", F.lit(IGNORED))).withColumn("features", numeric_features(F.col("numeric_value"), F.col("ref_low"), F.col("ref_high")))
    out = out.join(F.broadcast(age_stats)).withColumn("age", age_days(since)).withColumn("age_normalized", age_normalized(since, F.col("mean"), F.col("std")))
    return out.select(*SAMPLE, "ord", "embedding_text_id", "label", "features", "age", "age_normalized")


def assembled(rows: DataFrame) -> DataFrame:
    """One row a sample with the four parallel arrays, floats narrowed last; samples without rows have none."""
    item = F.struct("ord", "embedding_text_id", "label", "features", "age", "age_normalized")
    own = rows.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(item)).alias("e"))
    floats = lambda name: F.transform("e", lambda x: x[name].cast("float")).alias(name)
    return own.select(
        *SAMPLE,
        F.transform("e", lambda x: x["embedding_text_id"]).alias("embedding_text_ids"),
        F.transform("e", lambda x: x["label"]).alias("token_ids"),
        F.transform("e", lambda x: x["features"].cast("array<float>")).alias("numeric_features"),
        floats("age"),
        floats("age_normalized"),
        F.size("e").alias("length"),
    )
