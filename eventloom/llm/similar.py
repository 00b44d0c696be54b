"""Near copies by exact Jaccard similarity of word shingles; MinHash bands name the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, map_arrow, release, small, sql_type

WIDTH, LEAST, SEED = 5, 0.8, 42
#: Two texts of similarity s share a band with probability 1 - (1 - s**rows)**bands. The first bands are made of every text and
#: name those that may have a near copy (0.9996 at 0.8); the fine ones are made of these alone and name the pairs to compare:
#: 0.9993 at 0.8, but 0.32 at 0.6 and 0.06 at 0.5, where the first have 0.80 and 0.47.
BANDS, ROWS = 20, 5
FINE_BANDS, FINE_ROWS = 64, 10
_BLOCK = 1 << 19
#: Buckets of no more documents are compared in pairs at once, larger ones with their first documents, up to HEADS a round.
SMALL_BUCKET, HEADS, GROWTH = 16, 4096, 16
#: Rows of a table between rounds that one task keeps.
TASK_ROWS = 100_000
_RANDOM = np.random.default_rng(SEED)
_FIRST, _FINE = ((_RANDOM.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1), _RANDOM.integers(0, 1 << 64, (n, 1), np.uint64)) for n in (BANDS * ROWS, FINE_BANDS * FINE_ROWS))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 values of a text's runs of `width` words, repeats included; a shorter text is one run, no words are none.

    Words part at the six ASCII spaces, A-Z count as lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    runs = map(b" ".join, zip(*(islice(words, k, None) for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - width + 1)


def bands(hashes: np.ndarray, fine: bool = False) -> np.ndarray:
    """A signed hash of each band's least values; none for no shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    (factor, shift), rows = (_FINE, FINE_ROWS) if fine else (_FIRST, ROWS)
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    step = _BLOCK // len(factor)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[at : at + step] * factor + shift).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(-1, rows)], np.uint64).view(np.int64)


def version(text: str = "text") -> Column:
    """Tells the texts under one id, or without one, apart."""
    return F.xxhash64(text)


def name(docs: DataFrame) -> Column:
    """A document's name, by which documents are ordered: doc_id, ones without it last, then the version of the text."""
    return F.struct(docs["doc_id"].isNull().alias("without"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("version"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(at, grams, bands): the distinct shingles of each text and its fine bands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingles(t, width)) for t in b.column("text").to_pylist()]
            grams, keys = [h.view(np.int64) for h in held], [bands(h, fine=True) for h in held]
            yield pa.RecordBatch.from_arrays([b.column("at"), *(pa.array(x, pa.list_(pa.int64())) for x in (grams, keys))], ["at", "grams", "bands"])

    return map_arrow(docs, scan, f"at {sql_type(docs, 'at')}, grams array<bigint>, bands array<bigint>")


def _shared(banded: DataFrame, *more: Column) -> DataFrame:
    """(at, ..., value): the bands of banded(at, bands) that more than one row has."""
    entry = banded.select("at", *more, F.explode("bands").alias("value"))
    filled = entry.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    return entry.join(small(filled), "value", "left_semi")


def near(sketched: DataFrame, docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(at): documents that one with a smaller name is similar to (Jaccard `least` or more of their sets of shingles); no two of
    the others are, as far as they share a band.

    sketched: (at, bands) of the documents to compare; docs: (at, text) of these and maybe others. Documents that share a first
    band with another are read again for their shingles and fine bands, whose buckets name the pairs: around a template with
    many edited copies most pairs are less similar than `least`, and few of those share a fine band. Buckets of up to
    SMALL_BUCKET documents are paired off. In larger ones, round by round, the first 1, 16, 256, ... documents are compared with
    the others, and those that are similar go: a group of near copies costs its size, not its square. A large bucket of
    documents that are not similar costs the pairs of its documents of like size in the end. Sizes too far apart for the
    similarity are not compared; no pair is compared twice.
    """
    asked = cut(_shared(sketched).select("at").distinct())
    sets = cut(_sets(docs.join(small(asked), "at", "left_semi"), width).dropDuplicates(["at"]))
    met = cut(_shared(sets, F.size("grams").cast("bigint").alias("size")).distinct())
    sets = sets.select("at", "grams")
    gone, tested, heads = asked.limit(0), None, 1
    while rows := met.count():
        parts = lambda df, most: df.coalesce(-(-most // TASK_ROWS))  # noqa: B023, E731
        filled = cut(parts(met.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rows))
        few, many = (small(filled.where(c).select("value")) for c in (F.col("n") <= SMALL_BUCKET, F.col("n") > SMALL_BUCKET))
        rest = met.join(many, "value", "left_semi")
        ranked = cut(parts(rest.withColumn("place", F.expr("row_number() over (partition by value order by at)")).where(F.col("place") <= heads).drop("place"), rows))
        as_head = lambda x: x.withColumnsRenamed({"at": "head", "size": "head_size"})
        paired = met.join(few, "value", "left_semi")
        pairs = paired.join(as_head(paired), "value").unionByName(rest.join(as_head(ranked), "value"))
        pairs = pairs.where((F.col("head") < F.col("at")) & (F.least("size", "head_size") >= least * F.greatest("size", "head_size"))).select("at", "head").distinct()
        pairs = cut(parts(pairs if tested is None else pairs.join(tested, ["at", "head"], "left_anti"), rows * min(heads + SMALL_BUCKET, rows)))
        members = cut(parts(pairs.select("at").unionByName(pairs.select(F.col("head").alias("at"))).distinct(), rows))
        used = sets.join(small(members), "at", "left_semi")
        both = pairs.join(used, "at").join(used.withColumnsRenamed({"at": "head", "grams": "others"}), "head")
        shared = both.withColumn("both", F.size(F.array_intersect("grams", "others")))
        found = cut(parts(shared.where(F.col("both") >= least * (F.size("grams") + F.size("others") - F.col("both"))).select("at").distinct(), rows * 8))
        gone = gone.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        before, met = met, cut(parts(rest.join(ranked, ["value", "at"], "left_anti").join(small(found), "at", "left_anti"), rows))
        release(before, filled, members, ranked)
        heads = min(GROWTH * heads, HEADS)
    return cut(gone.distinct())
