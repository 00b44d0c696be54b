"""Quality rules: counts of whole texts, and a hashed n-gram likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, fields, map_arrow, release, small, sql_type

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
LEAST_WORDS, MOST_REPEATED = 50, 50
BUCKETS = 1 << 14
#: Of the labelled trusted documents, so many score above the threshold at least.
TRUSTED_KEPT = 0.995


@dataclass
class Ratio:
    """log p(bucket | trusted) - log p(bucket | raw), and the least length-normalised score that is kept."""

    weights: np.ndarray
    threshold: float = -np.inf


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ids: a number for each word, equal for equal words."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # pairs are numbered first, so that what names a window still fits
        windows = (np.unique((ids[:-2] << 32) | ids[1:-1], return_inverse=True)[1] << 32) | ids[2:]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[k : k + len(twice)] |= twice
    return int(marked.sum())


def numbers(words: list[str]) -> np.ndarray:
    """An exact number for each distinct word of a text, below their count."""
    own: dict[str, int] = {}
    return np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated_words(numbers(words))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        h = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h


class Grams:
    """Buckets of a text's unigrams and bigrams of words and punctuation runs; tokens are hashed once for each worker."""

    def __init__(self, buckets: int = BUCKETS, words: int = 500_000) -> None:
        self.buckets, self.words, self.held = np.uint64(buckets), words, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        if len(self.held) > self.words:
            self.held.clear()
        hashes = np.fromiter(map(self.held.__getitem__, tokens), np.uint64, len(tokens))
        mix = np.uint64(0x9E3779B97F4A7C15)
        one = (hashes + np.uint64(1)) * mix
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * mix + one[1:]
        return ((np.concatenate([one, two]) * mix >> np.uint64(40)) % self.buckets).astype(np.int64)


def _counted(df: DataFrame, buckets: int) -> DataFrame:
    """(trusted, bucket, n): summed over all rows of df(text, trusted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, trusted = Grams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            found: dict[bool, list[np.ndarray]] = {True: [], False: []}
            for text, good in zip(b.column("text").to_pylist(), b.column("trusted").to_pylist(), strict=True):
                if text:
                    found[good].append(grams(text))
            for good, counts in ((True, trusted), (False, raw)):
                if found[good]:
                    counts += np.bincount(np.concatenate(found[good]), minlength=buckets)
        for flag, counts in ((False, raw + trusted), (True, trusted)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), flag)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["trusted", "bucket", "n"])

    return map_arrow(df, count, "trusted boolean, bucket int, n bigint").groupBy("trusted", "bucket").agg(F.sum("n").alias("n"))


def worst_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good, trusted) of each labelled document: whether its quality is 1, and whether it is not toxic besides.

    A document labelled more than once counts by its worst labels; labels without id or quality are left out.
    """
    known = fields(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return one.selectExpr("doc_id", "quality = 1 as good", "quality = 1 and toxic = 0 as trusted")


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted) of each row of docs; trusted: distinct ids. Texts move only if there are too many ids to broadcast."""
    rows, ids = fields(docs, "doc_id", "text"), trusted.select(F.col("doc_id").alias("_id"))
    near, match, flag = small(ids), F.col("doc_id") == F.col("_id"), F.col("_id").isNotNull().alias("trusted")
    if near is not ids:
        return rows.join(near, match, "left").select("text", flag)
    # Hashed ids, so that no text is sorted; rows without id match none and would all go to one task.
    with_id = rows.where("doc_id is not null").join(ids.hint("shuffle_hash"), match, "left").select("text", flag)
    return with_id.union(rows.where("doc_id is null").select("text", F.lit(False).alias("trusted")))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> Ratio:
    """The ratio: the target multinomial from all documents whose id is in trusted, the raw one from every document."""
    counts = np.zeros((2, buckets))
    for trusted, bucket, n in _counted(marked(docs, trusted), buckets).collect():
        counts[int(trusted), bucket] = n
    smooth = counts + 0.5
    log = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return Ratio(log[1] - log[0] if counts[1].any() else np.zeros(buckets))


def scored(docs: DataFrame, ratio: Ratio, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts and llr, the mean weight of the text's n-grams (0 without any), for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(ratio.weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, grams = held.value, Grams(buckets)
        for b in batches:
            counts, llr = np.zeros((5, b.num_rows), np.int64), np.zeros(b.num_rows)
            for i, text in enumerate(b.column("text").to_pylist()):
                if text:
                    counts[:, i] = base_counts(text)
                    at = grams(text)
                    llr[i] = weights[at].mean() if len(at) else 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(llr)], ["doc_id", *names, "llr"])

    return map_arrow(fields(docs, "doc_id", "text"), score, f"doc_id {sql_type(docs, 'doc_id')}, " + ", ".join(f"{n} bigint" for n in names) + ", llr double")


def gains(good: np.ndarray, bad: np.ndarray, totals: tuple[int, int], kept: float) -> np.ndarray:
    """How well cuts part the classes: the share of other labelled documents below each less that of trusted ones; -inf where
    it would cost more than 1 - kept of these. good, bad: how many are below each cut."""
    lost = good / totals[0]
    return np.where(lost <= 1 - kept, bad / totals[1] - lost, -np.inf)


def least_score(scores: list[tuple[float, bool]], kept: float = TRUSTED_KEPT) -> float:
    """The threshold of scores in memory: midway between the two that part trusted from other labelled documents best, the
    lowest of equal cuts. Keeps everything if either class is missing or no cut is allowed."""
    edges, at = np.unique([s for s, _ in scores], return_inverse=True)
    flags = np.array([g for _, g in scores], bool)
    if flags.all() or not flags.any() or len(edges) < 2:
        return -np.inf
    good, bad = (np.cumsum(np.bincount(at[flags == g], minlength=len(edges)))[:-1] for g in (True, False))
    gain = gains(good, bad, (int(flags.sum()), int((~flags).sum())), kept)
    best = int(np.argmax(gain))
    return float((edges[best] + edges[best + 1]) / 2) if gain[best] > -np.inf else -np.inf


def least_of(scores: DataFrame, kept: float = TRUSTED_KEPT) -> float:
    """least_score of all rows of scores(llr, good): equal scores are counted, the counts dealt by range of score, and each
    range adds what is below it and gives its best cuts."""
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tally = scores.groupBy("llr").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    dealt = cut(tally.repartitionByRange(n, "llr").sortWithinPartitions("llr").withColumn("part", F.spark_partition_id()))
    before, good, bad, highest = {}, 0, 0, -np.inf
    for p in dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("llr").alias("highest")).orderBy("highest").collect():
        before[p.part] = (good, bad)
        good, bad, highest = good + p.good, bad + p.bad, p.highest
    totals = (good, bad)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = None
        for b in batches:
            llr, goods, bads, parts = (b.column(c).to_numpy() for c in ("llr", "good", "bad", "part"))
            if not len(llr):
                continue
            below = before[parts[0]] if below is None else below
            goods, bads = below[0] + np.cumsum(goods), below[1] + np.cumsum(bads)
            below = (goods[-1], bads[-1])
            gain = np.where(llr < highest, gains(goods, bads, totals, kept), -np.inf)  # no cut is above the highest score
            at = int(np.argmax(gain))
            yield pa.RecordBatch.from_arrays([pa.array(llr[at : at + 1]), pa.array(gain[at : at + 1])], ["llr", "gain"])

    least = -np.inf
    if good and bad:
        edge = map_arrow(dealt, best, "llr double, gain double").orderBy(F.desc("gain"), "llr").first()
        if edge.gain > -np.inf:
            least = (edge.llr + dealt.where(F.col("llr") > edge.llr).agg(F.min("llr")).first()[0]) / 2
    release(dealt)
    return least


def rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept for each row of docs.

    Trusted documents are all those labelled quality 1 and not toxic; raw counts and the verdicts cover all documents, and the
    threshold all labelled ones that pass the base rules. A null text has no words and fails; null ids and repeated rows are
    scored like others; without labels only the base rules decide; an empty table gives no rows.
    """
    known = cut(worst_labels(labels))
    out = cut(scored(docs, fit(docs, known.where("trusted"), buckets), buckets))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    threshold = least_of(out.where(~failed).select("doc_id", "llr").join(small(known.select("doc_id", "good")), "doc_id").select("llr", "good"))
    release(known)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
