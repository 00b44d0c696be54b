"""SimHash fingerprints of whole texts and their near copies by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import similar
from eventloom.llm.common import cut, fields, map_arrow, release, small, sql_type
from eventloom.llm.graph import components

WIDTH, RADIUS = 3, 2
#: A table bucket with more fingerprints than this is searched through common neighbours, not in pairs.
WIDE_BUCKET = 64
_BLOCK = 255 * 256


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # eight one-byte counters in each word
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash: a bit is 1 if over half the shingles' XXH64 values have it; no words: 0."""
    return majority(similar.shingles(text, width))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(x) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint): one row for each row of docs, without a shuffle. A null text counts as empty: fp 0."""
    return map_arrow(fields(docs, "doc_id", "text"), _signed, f"doc_id {sql_type(docs, 'doc_id')}, fp bigint")


def links(prints: DataFrame, wide_bucket: int = WIDE_BUCKET) -> DataFrame:
    """(a, b): linked pairs of distinct fingerprints, enough of them to connect every two that differ in at most 2 bits.

    Multi-index hashing with two 32-bit segments. Two fingerprints within 2 bits either agree in the low segment or differ in
    at most one bit of the high one, so the low table is probed exactly and the high table with the Hamming ball of radius 1;
    of a pair that differs in one high bit, the side with a 0 there probes the other. Matches are verified over all 64 bits.

    Every probe meets at most `wide_bucket` entries that way. Fingerprints that probe a fuller bucket - many texts around one
    template - emit their 65 neighbours within one bit instead: two fingerprints are within 2 bits just if they share such a
    neighbour, and a neighbour has 65 fingerprints around it at most, so there too no group grows with the data.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    key = lambda seg, k: F.struct(F.lit(seg).alias("seg"), k.alias("key"))
    ball = F.expr("transform(filter(sequence(0, 31), i -> ((shiftrightunsigned(fp, 32) >> i) & 1) = 0), i -> struct(1 as seg, shiftrightunsigned(fp, 32) | shiftleft(1L, i) as key))")
    entries = prints.select("fp", F.explode(F.array(key(0, low), key(1, high))).alias("e")).select("e.seg", "e.key", F.col("fp").alias("b"))
    probes = prints.select("fp", F.explode(F.concat(F.array(key(0, low), key(1, high)), ball)).alias("e")).select("e.seg", "e.key", F.col("fp").alias("a"))
    filled = entries.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    met = cut(probes.join(filled, ["seg", "key"]).where("n > 1 or key != if(seg = 0, a & 4294967295L, shiftrightunsigned(a, 32))"))  # else it met itself alone
    narrow = met.where(F.col("n") <= wide_bucket).join(entries, ["seg", "key"])
    found = narrow.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    around = met.where(F.col("n") > wide_bucket).select("a").distinct()
    near = around.select("a", F.explode(F.expr("concat(array(a), transform(sequence(0, 63), i -> a ^ shiftleft(1L, i)))")).alias("z"))
    least = near.groupBy("z").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("z", "b")
    if not around.isEmpty():
        found = found.unionByName(near.join(least, "z").where("a != b").select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, wide_bucket: int = WIDE_BUCKET) -> DataFrame:
    """(doc_id, fp bigint, component_id): near-copy components of docs, one row for each row.

    Equal fingerprints are first merged, so exact copies never meet one another; component_id is the smallest doc_id that can
    be reached over links of at most 2 differing bits. Null texts count as empty (fingerprint 0, linked like any other); rows
    with a null doc_id take part and get a component_id, null only where no row of the component has an id. Repeated rows stay.
    """
    signed = cut(fingerprints(docs))
    prints = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(prints.select("fp"), wide_bucket), "a", "b").select(F.col("node").alias("fp"), "root")
    placed = cut(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    heads = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = cut(placed.join(heads, "root").select("fp", "component_id"))
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def sketches(docs: DataFrame, width: int = similar.WIDTH) -> DataFrame:
    """(at, fp, bands) of each row of docs(at, text): fingerprint and MinHash bands from one pass over the text's shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, held = np.zeros(b.num_rows, np.uint64), []
            for i, text in enumerate(b.column("text").to_pylist()):
                hashes = similar.shingles(text, width)
                prints[i] = majority(hashes)
                held.append(similar.bands(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(prints.view(np.int64)), pa.array(held, pa.list_(pa.int64()))], ["at", "fp", "bands"])

    return map_arrow(docs, scan, f"at {sql_type(docs, 'at')}, fp bigint, bands array<bigint>")


def one_of_each(docs: DataFrame, width: int = similar.WIDTH, least: float = similar.LEAST, wide_bucket: int = WIDE_BUCKET) -> DataFrame:
    """docs with one document of each group of near copies: first of each component of SimHash fingerprints of `width` words within
    2 bits, then, of what these leave, none whose shingles have a Jaccard similarity of `least` or more with one of a smaller id.

    The document with the smallest id stays, one with an id rather than one without, the smallest version (hash of the text)
    among equal ids. Different texts under one id are documents of their own; rows with equal id and text leave one row. A null
    text counts as empty, and all without words are copies of one another. Columns are as they were, whatever their names; an
    empty table stays empty. Texts move only where what goes or repeats is too much to broadcast: names are what is joined.
    """
    rows = docs.select(similar.name(docs).alias("at"), docs["text"].alias("text"))
    signed = cut(sketches(rows, width))
    prints = cut(signed.groupBy("fp").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("rows")))
    linked = cut(links(prints.select("fp"), wide_bucket))
    placed = prints.join(components(linked, "a", "b").withColumnsRenamed({"node": "fp"}), "fp", "left").where("rows > 1 or root is not null")
    placed = cut(placed.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    heads = cut(placed.join(placed.groupBy("root").agg(F.min("least").alias("head")), "root").select("fp", "head"))
    copies = cut(signed.join(small(heads), "fp").where("at != head").select("at").distinct())
    release(prints, linked, placed)
    gone = copies.unionByName(similar.near(signed.join(small(copies), "at", "left_anti").select("at", "bands"), rows, width, least))
    again = cut(signed.groupBy("at").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("at").join(gone, "at", "left_anti"))
    release(signed)
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), similar.name(docs).alias("at"))
    once = named.join(small(cut(gone.unionByName(again))), "at", "left_anti")
    if not again.isEmpty():
        once = once.unionByName(named.join(small(again), "at", "left_semi").dropDuplicates(["at"]))
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns))
