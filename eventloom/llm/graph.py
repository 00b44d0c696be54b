"""Connected components by alternating large and small stars over checkpointed edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, release


def _pointed(pairs: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is linked to another; root is the component's smallest node.

    links holds undirected pairs of any orderable type; nulls and self links are left out, repeats do no harm. Each round
    hooks every node's larger neighbours, then its smaller ones, to the smallest; only (node, minimum) pairs and edges move,
    minima are combined before shuffles, and no component is ever gathered. Ends when no edge changes.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = cut(edges)
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_pointed(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(_pointed(large), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, cut(small.unionByName(_pointed(large).select("u", F.col("m").alias("v"))).distinct())
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
