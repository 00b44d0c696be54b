"""The parts of the model that are data: gates, rotary features, projections, losses, representations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from eventloom.constants import IGNORED


def rope(age: Column, dim: int, base: float = 10_000.0) -> Column:
    """array<struct<sin, cos>> of an age in days at dim / 2 frequencies, base ** -x for x evenly spaced over [0, 2]."""
    n = dim // 2
    step = 2.0 / (n - 1) if n > 1 else 0.0
    angle = lambda i: age * F.pow(F.lit(base), -(i * F.lit(step)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.sin(angle(i)).alias("sin"), F.cos(angle(i)).alias("cos")))


def film(projected: Column, gamma: Column, beta: Column, features: Column) -> Column:
    """gamma * projected + beta where the features say that a value is there, the projection itself elsewhere."""
    moved = F.transform(F.arrays_zip(projected.alias("p"), gamma.alias("g"), beta.alias("b")), lambda x: x["p"] * x["g"] + x["b"])
    return F.when(F.get(features, F.lit(3)) > 0.5, moved).otherwise(projected)


def present(features: Column) -> Column:
    return F.get(features, F.lit(3)) > 0.5


def last_token(values: Column) -> Column:
    """The last element; null for an empty array."""
    return F.try_element_at(values, F.lit(-1))


def cross_entropy(logits: DataFrame) -> DataFrame:
    """One row (loss, n): mean of logsumexp(logits) - logits[label] over labelled rows of (logits array<double>, label int)."""
    own = logits.where(F.col("label") != IGNORED)
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return own.select((F.log(total) + top - F.get("logits", F.col("label"))).alias("l")).agg(F.avg("l").alias("loss"), F.count(F.lit(1)).alias("n"))


def rms_norm(values: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    size = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / F.size(values)
    scaled = F.transform(values, lambda x: x / F.sqrt(size + eps))
    return scaled if weight is None else F.zip_with(scaled, weight, lambda x, w: x * w)


def mlp(df: DataFrame, column: str, first: Any, second: Any, out: str) -> DataFrame:
    """df with `out`: second @ gelu(first @ x) of an array column, in Arrow batches; weights as (matrix, bias) arrays."""
    import numpy as np

    w1, b1, w2, b2 = (np.asarray(a, np.float32) for a in (*first, *second))
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        from math import erf

        gelu = np.vectorize(lambda x: 0.5 * x * (1 + erf(x / 2**0.5)), otypes=[np.float32])
        for f in frames:
            if len(f):
                x = np.stack(f[column].to_numpy()).astype(np.float32)
                f = f.assign(**{out: [v.tolist() for v in gelu(x @ w1.T + b1) @ w2.T + b2]})
            else:
                f = f.assign(**{out: []})
            yield f

    return df.mapInPandas(run, schema)


def block_attention(df: DataFrame, width: int | None = None) -> DataFrame:
    """(sample_id, out array<array<float>>): causal attention within each sample, over the last `width` places if given.

    df: (sample_id, q, k, v), arrays of vectors, one row a sample, so no row sees another's.
    """

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        import numpy as np

        for f in frames:
            found = []
            for q, k, v in zip(f["q"], f["k"], f["v"], strict=True):
                q, k, v = (np.stack([np.asarray(r, np.float64) for r in x]) for x in (q, k, v))
                n = len(q)
                apart = np.arange(n)[:, None] - np.arange(n)[None, :]
                seen = (apart >= 0) & ((apart < width) if width else True)
                score = np.where(seen, q @ k.T / np.sqrt(q.shape[1]), -np.inf)
                weight = np.exp(score - score.max(axis=1, keepdims=True))
                found.append((weight / weight.sum(axis=1, keepdims=True) @ v).astype(np.float32).tolist())
            yield f[["sample_id"]].assign(out=found)

    return df.select("sample_id", "q", "k", "v").mapInPandas(run, "sample_id bigint, out array<array<float>>")
