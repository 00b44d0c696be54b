"""Language-model scores: quantised n-gram counts in a log-frequency Bloom filter, broadcast to the workers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as hashed

from eventloom.llm.common import cut, fields, in_split, map_arrow, release, sql_type, steady

FOLDS, HELD_OUT = 7, 2
#: The token after a text's last word; no word is empty.
END = ""
#: Base of the quantisation: level q stands for counts from BASE**(q-1) to below BASE**q.
BASE = 2.0
BITS, PROBES = 8, 4
#: The largest filter that is broadcast; more n-grams are scored in blocks of such filters, one pass over the texts for each.
FILTER_BYTES = 256 << 20
#: Counts that meet in one range of hashes, in bytes: the number of ranges follows the measured number of tokens.
SEGMENT_BYTES = 32 << 20
#: So many of the most frequent words have their exact counts broadcast; the rest are joined.
FREQUENT = 1 << 17
#: Share of the bigram estimate in the interpolated probability.
BIGRAM_SHARE = 0.4
_CACHED, _SEED = 250_000, 7
_LOW = np.uint64(0xFFFFFFFF)
_MIX, _STEP, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = hashed(word, _SEED)
        return h


class _Numbers(dict):
    """Words in the order of their first look-up."""

    def __init__(self) -> None:
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = (before ^ (before >> np.uint64(31))) * _PAIR + after
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1


def expected(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric mean of its least and greatest count; 0 for level 0."""
    low, high = np.ceil(BASE ** (level - 1.0) - 1e-9), np.ceil(BASE**level - 1e-9) - 1
    return np.where(level > 0, np.sqrt(low * np.maximum(low, high)), 0.0)


def _places(hashes: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions of (hash, level) in a segment of the given size, one array a probe."""
    g = (hashes + np.uint64(level * int(_STEP) % (1 << 64))) * _MIX
    g ^= g >> np.uint64(32)
    one, two = g & _LOW, (g >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((one + np.uint64(i) * two) & _LOW) * sizes >> np.uint64(32)  # sizes are below 2**32


def ranges(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash: segments cut the hash space into equal ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def segment(hashes: np.ndarray, counts: np.ndarray, bits: float = BITS) -> np.ndarray:
    """The bit array of one range: every n-gram is entered once for each level up to its own."""
    top = levels(counts)
    size = max(64, -(-int(top.sum() * bits) // 8) * 8)
    out = np.zeros(size, bool)
    for q in range(1, int(top.max(initial=0)) + 1):
        at = hashes[top >= q]
        for place in _places(at, q, np.uint64(size)):
            out[place] = True
    return np.packbits(out, bitorder="little")


@dataclass
class Filter:
    """Segments of a log-frequency Bloom filter. own: whether this block answers for a range; elsewhere, and where no n-gram is,
    size is 0. top: the highest level that was entered, where probing ends."""

    bits: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    own: np.ndarray
    top: int

    @staticmethod
    def of(parts: dict[int, bytes], segments: int, top: int) -> Filter:
        sizes = np.array([8 * len(parts.get(r, b"")) for r in range(segments)], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if segments else sizes
        return Filter(np.frombuffer(b"".join(parts.get(r, b"") for r in range(segments)), np.uint8), offsets.astype(np.uint64), sizes.astype(np.uint64), np.array([r in parts for r in range(segments)], bool), top)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level that repeated probes find, 0 for none; n-grams of absent segments too."""
        out = np.zeros(len(hashes), np.int64)
        r = ranges(hashes, len(self.sizes))
        live = np.flatnonzero(self.sizes[r] > 0)
        for q in range(1, self.top + 1):
            size, start = self.sizes[r[live]], self.offsets[r[live]]
            keep = np.arange(len(live))
            for place in _places(hashes[live], q, size):
                at = (start + place)[keep]
                keep = keep[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
                if not len(keep):
                    break
            live = live[keep]
            out[live] = q
            if not len(live):
                break
        return out


def _blobs(hashes: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """One row for each range that has n-grams: sorted hashes and their counts as bytes."""
    cuts = np.searchsorted(ranges(hashes, segments), np.arange(segments + 1))
    held = np.flatnonzero(np.diff(cuts))
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(held.astype(np.int32)), *(pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in held], pa.binary()) for x in (hashes, counts))], ["r", "hashes", "counts"]
    )


_BLOBS = "r int, hashes binary, counts binary"


def bigram_blobs(train: DataFrame, segments: int) -> DataFrame:
    """Bigram counts of each task's texts, by range; a task holds a bounded number of hashes at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, n = _Hashes(), [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                if len(held) > _CACHED:
                    held.clear()
                words = tokens_of(text)
                h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
                parts.append(pair_hashes(np.roll(h, 1), h))  # the end stands before the first word
                n += len(h)
                if n >= 1 << 22:
                    yield _blobs(*np.unique(np.concatenate(parts), return_counts=True), segments)
                    parts, n = [], 0
        if parts:
            yield _blobs(*np.unique(np.concatenate(parts), return_counts=True), segments)

    return map_arrow(train.select("text"), count, _BLOBS)


def word_blobs(counts: DataFrame, segments: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([hashed(w.encode("utf-8", "surrogatepass"), _SEED) for w in b.column("word").to_pylist()], np.uint64)
            order = np.argsort(h)
            yield _blobs(h[order], b.column("n").to_numpy()[order], segments)

    return map_arrow(counts, count, _BLOBS)


def segments_of(blobs: DataFrame, segments: int, bits: float = BITS) -> DataFrame:
    """(r, top, bits): the finished segment of each range and its highest level, built where the range's counts meet, a partition for each range."""

    def build(rows):
        import pandas as pd

        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]])
        own, where = np.unique(hashes, return_inverse=True)
        total = np.bincount(where, counts).astype(np.int64)
        return pd.DataFrame({"r": [rows["r"].iloc[0]], "top": [int(levels(total).max())], "bits": [segment(own, total, bits).tobytes()]})

    return cut(blobs.repartition(segments, "r").groupBy("r").applyInPandas(build, "r int, top int, bits binary"))


def ranges_for(tokens: int) -> int:
    """How many ranges keep the counts of so many tokens (12 bytes each at most) to SEGMENT_BYTES a range."""
    return max(8, -(-12 * tokens // SEGMENT_BYTES))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): exact counts of all training tokens, combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                own.update(tokens_of(text))
                if len(own) > _CACHED:
                    yield rows(own)
                    own = Counter()
        yield rows(own)

    def rows(own: Counter[bytes]) -> pa.RecordBatch:
        words = pa.array(list(own), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(own.values()), pa.int64())], ["word", "n"])

    return map_arrow(train.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Scorer:
    """Scores token batches against the broadcast filters and the frequent words' counts."""

    def __init__(self, words: Filter | None, pairs: Filter, frequent: dict[bytes, int], total: int, distinct: int) -> None:
        self.words, self.pairs, self.frequent = words, pairs, frequent
        self.least = total + distinct + 1
        self._clear()

    def _clear(self) -> None:
        self.at = _Numbers()
        self.hashes, self.estimate, self.exact = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def ids(self, docs: list[list[bytes]], found: list[bytes] | None = None) -> list[np.ndarray]:
        """The texts' words by number. found: their levels, a byte a token, where the word filter was too large to be held here."""
        if len(self.at) > _CACHED:
            self._clear()
        out = [np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)) for ws in docs]
        fresh = self.at.names[len(self.hashes) :]
        if fresh:
            h = np.array([hashed(w, _SEED) for w in fresh], np.uint64)
            self.hashes = np.concatenate([self.hashes, h])
            self.estimate = np.concatenate([self.estimate, expected(self.words.level(h)) if found is None else np.zeros(len(h))])
            get = self.frequent.get
            self.exact = np.concatenate([self.exact, np.array([get(w, 0) for w in fresh], np.int64)])
        if found is not None:
            self.estimate[np.concatenate(out)] = expected(np.frombuffer(b"".join(found), np.uint8).astype(np.int64))
        return out

    def log_probs(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of each token after the one before it; 0 where another block of the filter has its range."""
        pairs, where = np.unique((before << 32) | ids, return_inverse=True)
        before, ids = pairs >> 32, pairs & 0xFFFFFFFF
        h = pair_hashes(self.hashes[before], self.hashes[ids])
        mine = self.pairs.own[ranges(h, len(self.pairs.own))]
        seen, context = expected(self.pairs.level(h)), self.estimate[before]
        bigram = np.where(context > 0, np.minimum(seen / np.maximum(context, 1), 1), 0)
        alone = (self.estimate[ids] + 1) / self.least
        logs = np.log10(np.where(context > 0, BIGRAM_SHARE * bigram + (1 - BIGRAM_SHARE) * alone, alone))
        return np.where(mine, logs, 0.0)[where]


def _partial(docs: DataFrame, scorer, first: bool) -> DataFrame:
    """Rows to be summed by rid: for each text one with what the broadcast tables tell, and for its other words one each."""
    kind = sql_type(docs, "doc_id")
    schema = f"rid bigint, word string, tf bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, lm double"
    names = [f.split()[0] for f in schema.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer()
        for b in batches:
            if b.num_rows:
                yield block(own, [tokens_of(t) for t in b.column("text").to_pylist()], b)

    given = "levels" in docs.columns

    def block(own: Scorer, docs: list[list[bytes]], b: pa.RecordBatch) -> pa.RecordBatch:
        per = own.ids(docs, b.column("levels").to_pylist() if given else None)
        ids, before = np.concatenate(per), np.concatenate([np.roll(x, 1) for x in per])
        lengths = np.array([len(x) for x in per])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        lm = np.add.reduceat(own.log_probs(ids, before), starts)
        rids = b.column("rid").to_numpy()
        exact = own.exact[ids]
        known = np.add.reduceat((exact > 0).astype(np.int64), starts)
        base = np.add.reduceat(np.log10(exact + 1.0), starts)
        rare = np.flatnonzero(exact == 0) if first else np.zeros(0, np.int64)
        pairs, tf = np.unique((np.repeat(np.arange(len(docs)), lengths)[rare] << 32) | ids[rare], return_counts=True)
        words = [own.at.names[i] for i in (pairs & 0xFFFFFFFF).tolist()]
        more = len(pairs)
        own_words = pa.array([f"\n{r}" for r in rids.tolist()], pa.string())  # white space: no word, and no two alike
        pad = lambda a, t: pa.concat_arrays([pa.array(a, t), pa.nulls(more, t)])
        cols = [
            pa.array(np.concatenate([rids, rids[pairs >> 32]])),
            pa.concat_arrays([own_words, pa.array(words, pa.binary()).cast(pa.string())]),
            pa.array(np.concatenate([np.zeros(len(docs), np.int64), tf])),
            pa.concat_arrays([b.column("doc_id"), pa.nulls(more, b.column("doc_id").type)]),
            pa.concat_arrays([b.column("held_out"), pa.nulls(more, pa.bool_())]),
            pad(lengths if first else lengths * 0, pa.int64()),
            pad(known if first else known * 0, pa.int64()),
            pad(base if first else base * 0, pa.float64()),
            pad(lm, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, score, schema)


def blocks_of(segments: DataFrame, count: int, most: int) -> Iterator[Filter]:
    """Filters of at most `most` bytes each (a larger segment is one of its own), fetched one partition of segments at a time.

    Every range is in one block: the first also has those without any n-gram."""
    held_by = segments.select("r", "top").collect()
    present, top = {r.r for r in held_by}, max((r.top for r in held_by), default=0)
    absent, held, room = {r: b"" for r in range(count) if r not in present}, {}, most
    for row in segments.select("r", "bits").toLocalIterator():
        if held and len(row.bits) > room:
            yield Filter.of(absent | held, count, top)
            absent, held, room = {}, {}, most
        held[row.r] = bytes(row.bits)
        room -= len(row.bits)
    yield Filter.of(absent | held, count, top)


def _levelled(docs: DataFrame, block: Filter) -> DataFrame:
    """docs with `levels`, a byte for each token: what the block finds of the words of its ranges, beside what earlier blocks found."""
    held, first = docs.sparkSession.sparkContext.broadcast(block), "levels" not in docs.columns
    own = [c for c in docs.columns if c != "levels"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes = held.value, _Hashes()
        for b in batches:
            if len(hashes) > _CACHED:
                hashes.clear()
            out = []
            for text, before in zip(b.column("text").to_pylist(), [None] * b.num_rows if first else b.column("levels").to_pylist(), strict=True):
                words = tokens_of(text)
                found = block.level(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))).astype(np.uint8)
                out.append((found if before is None else found | np.frombuffer(before, np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(out, pa.binary())], [*own, "levels"])

    return map_arrow(docs, look, ", ".join(f"{c} {sql_type(docs, c)}" for c in own) + ", levels binary")


def score(docs: DataFrame, segments: int | None = None, filter_bytes: int = FILTER_BYTES, frequent: int = FREQUENT, bits: float = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    base_score is exact: the `frequent` most frequent training words are broadcast with their counts, each text's other words
    are joined with the count table. score is the model's: p(w | v) mixes c(v w) / c(v) with the add-one unigram estimate, all
    counts from the filter, where level q of an n-gram is found by probing for levels 1, 2, ... until one is missing or the
    highest was met. The filter has no false negatives; a level is overstated with a chance of 2 to 3 % (8 bits, 4 probes an
    entry), whatever the size of the corpus.

    Counts meet range by range of their hashes (`segments` ranges; by default as many as their measured number needs), a
    finished segment for each; a bigram filter of more than `filter_bytes` is broadcast in blocks of segments, with a pass
    over the texts for each block, whose partial sums add up. A word filter of more is looked up in blocks first: each adds
    the levels of its words to the texts, which are kept in the checkpoint folder in between. Null texts are empty (the end
    alone); a null id counts as empty text for the fold; repeated rows are rows like others, since each row has a number of
    its own (input that is itself shuffled is cut first, so that the numbers hold when an executor is lost); columns other
    than doc_id and text have no effect; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = steady(fields(docs, "doc_id", "text")).withColumn("held_out", in_split(F.col("doc_id"), FOLDS, HELD_OUT)).withColumn("rid", F.monotonically_increasing_id())
    train = base.where(~F.col("held_out"))
    counts = cut(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    most = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    known = dict(zip(most["word"].cast(pa.binary()).to_pylist(), most["n"].to_pylist(), strict=True))
    of_words, of_pairs = segments or ranges_for(distinct), segments or ranges_for(total)
    held = segments_of(word_blobs(counts, of_words), of_words, bits)
    blocks = blocks_of(held, of_words, filter_bytes)
    words, later = next(blocks), next(blocks, None)
    if later is not None:
        for block in chain((words, later), blocks):
            before, base = base, cut(_levelled(base, block))
            if "levels" in before.columns:
                release(before)
        words = None
    release(held)
    pairs = segments_of(bigram_blobs(train, of_pairs), of_pairs, bits)
    tables = spark.sparkContext.broadcast((words, known, total, distinct))
    del most, known, words
    parts = None
    for k, block in enumerate(blocks_of(pairs, of_pairs, filter_bytes)):
        own = spark.sparkContext.broadcast(block)

        def scorer(own=own, tables=tables) -> Scorer:
            words, known, total, distinct = tables.value
            return Scorer(words, own.value, known, total, distinct)

        part = _partial(base, scorer, k == 0)
        parts = part if parts is None else parts.unionByName(part)
    release(pairs)
    found = parts.join(counts, "word", "left")
    tf = F.col("tf")
    out = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(F.col("n").isNotNull(), tf).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(tf * F.log10(F.coalesce("n", F.lit(0)) + 1))).alias("base"),
        F.sum("lm").alias("score"),
    )
    norm = F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")
