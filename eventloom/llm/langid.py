"""Language identification: piece unigrams over a fixed vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import fields, in_split, map_arrow, sql_type

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: The bound of the labelled sample: about so many documents a language.
LABELLED_DOCS = 1500
#: Rounds of expectation-maximisation over that sample, and what each piece's expected count is raised by.
ROUNDS, SMOOTHING = 2, 0.05
#: Sums are scaled every so many letters, so that products of probabilities stay in range, and longer words are scored by
#: so many letters at a time, what a piece can reach back over being carried.
SCALED, CHUNK = 16, 4096
#: Words of more letters take no part in fitting the pieces (they are scored like others).
LONGEST_FITTED = 1 << 14
#: Probability of a character that no piece covers, the same for every language.
STRANGE = 1e-7
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHED_WORDS = 400_000


@dataclass
class Model:
    """steps: piece -> row, with the pieces' endings; probs: rows x languages, row 0 for a lone character outside the vocabulary."""

    languages: list[str]
    steps: dict[str, int]
    probs: np.ndarray
    prior: np.ndarray
    longest: int


@lru_cache(4)
def vocabulary(path: str = PIECES) -> dict[str, int]:
    """The lower-case pieces of letters (and the word mark) in a sentencepiece model, numbered from 1 in the model's order."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [held.id_to_piece(i) for i in range(held.get_piece_size()) if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i))]
    kept = dict.fromkeys(p.lower() for p in plain if re.fullmatch(r"▁?[^\W\d_]+", p))
    return {p: i for i, p in enumerate(kept, 1)}


def with_endings(pieces: dict[str, int]) -> dict[str, int]:
    """pieces, and -1 for every ending of a piece that is none itself: where neither is found, no longer piece ends."""
    return {p[i:]: -1 for p in pieces for i in range(1, len(p))} | pieces


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def lattice(words: list[str], steps: dict[str, int], longest: int) -> np.ndarray:
    """(word, end - 1, length - 1) -> row of the piece that ends there, -1 without one; all words have one length.

    A lone character is always there (row 0 if strange). steps: pieces with their endings. What two neighbouring words
    begin with alike is copied, so sorted words are quicker."""
    n = len(words[0])
    wide = min(longest, n)
    out: list[int] = []
    get, before = steps.get, ""
    none = [[-1] * k for k in range(wide + 1)]
    for w in words:
        shared = 0
        while shared < len(before) and before[shared] == w[shared]:
            shared += 1
        if shared:
            out += out[len(out) - n * wide : len(out) - (n - shared) * wide]
        before = w
        for end in range(shared + 1, n + 1):
            out.append(max(get(w[end - 1], -1), 0))
            begin = end - 2
            while begin >= 0 and (p := get(w[begin:end])) is not None:
                out.append(p)
                begin -= 1
            out += none[wide - (end - 1 - begin)]
    return np.array(out, np.int32).reshape(len(words), n, wide)


def forward(rows: np.ndarray, probs: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs), each (position, word, language): sums * exp(logs) is the summed probability of all segmentations of each prefix.

    probs has one more row, of zeros, at its end for absent pieces. before: the last sums and logs of what precedes rows, from
    which the first positions are taken; without it there is one position, the empty prefix. Sums that a piece can still reach
    are scaled together."""
    words, n, wide = rows.shape
    size = (words, probs.shape[1])
    old, old_logs = before if before is not None else (np.ones((1, *size)), np.zeros((1, *size)))
    k = len(old)
    sums, logs = np.concatenate([old, np.zeros((n, *size))]), np.concatenate([old_logs, np.zeros((n, *size))])
    for i in range(n):
        end = k + i
        logs[end] = logs[end - 1]
        for length in range(1, min(wide, end) + 1):
            at = rows[:, i, length - 1]
            if length == 1 or (at >= 0).any():
                sums[end] += sums[end - length] * probs[at]
        if (i + 1) % SCALED == 0 or (before is not None and i == n - 1):
            scale = sums[end].copy()
            first = max(0, end - wide + 1)
            sums[first : end + 1] /= scale
            logs[first : end + 1] += np.log(scale)
    return sums, logs


def _by_length(words: list[str], block: int = 4096) -> Iterator[np.ndarray]:
    """Positions of words of one length, in blocks of no more letters than `block` words of usual length have."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        most = max(1, min(block, 24 * block // max(1, lengths[part[0]]))) if len(part) else block
        for i in range(0, len(part), most):
            yield part[i : i + most]


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """(word, language): log of the segmentation-marginalised probability of each whole word, whatever its length."""
    out = np.zeros((len(words), len(model.languages)))
    marked = ["▁" + w for w in words]
    probs = np.vstack([model.probs, np.zeros(len(model.languages))])
    for at in _by_length(marked):
        held, n, state = [marked[i] for i in at], len(marked[at[0]]), None
        for start in range(0, n, CHUNK):
            begin = max(0, start - model.longest + 1)
            rows = lattice([w[begin : start + CHUNK] for w in held], model.steps, model.longest)[:, start - begin :]
            sums, logs = forward(rows, probs, state)
            state = sums[-model.longest :], logs[-model.longest :]
        out[at] = np.log(sums[-1]) + logs[-1]
    return out


def _reversed(rows: np.ndarray) -> np.ndarray:
    """The lattice of the same pieces read from the words' ends: a piece of some length that ends at e ends at n - e + length there."""
    words, n, wide = rows.shape
    out = np.full_like(rows, -1)
    for length in range(1, wide + 1):
        out[:, length - 1 :, length - 1] = rows[:, length - 1 :, length - 1][:, ::-1]
    return out


def fit_pieces(words: dict[str, int], pieces: dict[str, int], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over its words: forward-backward gives each piece's
    expected count over all segmentations. Row 0 keeps the fixed probability of a strange character."""
    longest, steps = max(map(len, pieces), default=1), with_endings(pieces)
    counts = {"▁" + w: n for w, n in words.items() if len(w) < LONGEST_FITTED}
    strings = sorted(counts)
    weight = np.array([counts[s] for s in strings], float)
    size = len(pieces) + 1
    probs = np.full((size + 1, 1), 1.0 / size)
    probs[0], probs[-1] = STRANGE, 0
    for _ in range(rounds):
        expected = np.full(size, smoothing)
        for at in _by_length(strings):
            rows = lattice([strings[i] for i in at], steps, longest)
            n, wide = rows.shape[1:]
            ahead, logs = (x[:, :, 0] for x in forward(rows, probs))
            # The same from the end: what follows each position, seen as a prefix of the reversed words.
            behind, back = (x[::-1, :, 0] for x in forward(_reversed(rows), probs))
            total = np.log(ahead[n]) + logs[n]
            for start in range(n):
                for length in range(1, min(wide, n - start) + 1):
                    p = rows[:, start + length - 1, length - 1]
                    here = p > 0
                    if here.any():
                        scale = np.exp(logs[start] + back[start + length] - total) * weight[at]
                        expected += np.bincount(p[here], (ahead[start] * behind[start + length] * scale)[here] * probs[p[here], 0], minlength=size)
        expected[0] = 0
        probs[:size, 0] = expected / expected.sum()
        probs[0] = STRANGE
    return probs[:size, 0]


def fit(docs: DataFrame, path: str = PIECES, labelled_docs: int = LABELLED_DOCS) -> Model:
    """The model of all languages that occur as non-null labels of texts outside the held-out fold.

    Priors count all such rows. Pieces are fitted on about `labelled_docs` whole documents of each language, those whose hashed
    id falls below that number's share of the language's rows; each language is fitted on an executor.
    """
    spark = docs.sparkSession
    pieces = vocabulary(path)
    usable = fields(docs, "doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_split(F.col("doc_id"), FOLDS, HELD_OUT))
    rows = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], {}, np.zeros((len(pieces) + 1, 0)), np.zeros(0), 1)
    share = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, labelled_docs / rows[lang])))), F.col("lang"))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for w in words_of(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counted = map_arrow(sample, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    held = spark.sparkContext.broadcast(pieces)

    def train(rows):
        import pandas as pd

        lang = rows["lang"].iloc[0]
        fitted = fit_pieces(dict(zip(rows["word"], rows["n"], strict=True)), held.value)
        return pd.DataFrame({"lang": [lang], "probs": [fitted]})

    # A language's words are bounded by the sample's documents of it.
    fitted = {r.lang: r.probs for r in counted.groupBy("lang").applyInPandas(train, "lang string, probs array<double>").collect()}
    even = np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1))
    even[0] = STRANGE
    probs = np.column_stack([fitted.get(lang, even) for lang in languages])
    total = sum(rows.values())
    return Model(languages, with_endings(pieces), probs, np.log([rows[lang] / total for lang in languages]), max(map(len, pieces)))


class Scorer:
    """Predicts texts in batches; word scores are kept for a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.at = model, {}
        self.scores = np.zeros((0, len(model.languages)))

    def rows(self, words: list[list[str]]) -> list[np.ndarray]:
        known = self.at
        new = {w for ws in words for w in ws if w not in known}
        if len(known) + len(new) > _CACHED_WORDS and known:
            known.clear()
            self.scores = self.scores[:0]
            new = {w for ws in words for w in ws}
        if new:
            fresh = sorted(new)
            known.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
            self.scores = np.vstack([self.scores, word_scores(fresh, self.model)])
        return [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model, words = self.model, [words_of(t) for t in texts]
        preds, sure = [], []
        for text, at in zip(texts, self.rows(words) if model.languages else words, strict=True):
            if not len(at) or not model.languages or not any(map(str.isalpha, text)):
                preds.append(UNKNOWN)
                sure.append(0.0)
                continue
            log = model.prior + self.scores[at].sum(axis=0)
            best = int(np.argmax(log))
            preds.append(model.languages[best])
            sure.append(float(1 / sum(math.exp(x - log[best]) for x in log)))
        return preds, sure


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the posterior of the language) in place of columns of these names; no shuffle.

    Only the text decides. A null text, one without a letter, or no learned language at all gives und with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            lang, score = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*own, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {sql_type(docs, c)}" for c in own) + ", lang_pred string, score double"
    return map_arrow(docs.select(*(docs[c] for c in own)), predict, schema)


def identify(docs: DataFrame, path: str = PIECES, labelled_docs: int = LABELLED_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs; repeated rows and null ids are rows like others.

    A null text or one without a letter is und; texts and words of any length are scored whole; columns other than doc_id, text
    and lang have no effect, and lang none on a prediction; an empty table gives no rows."""
    found = predicted(fields(docs, "doc_id", "text"), fit(docs, path, labelled_docs))
    return found.select("doc_id", in_split(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, path: str = PIECES, labelled_docs: int = LABELLED_DOCS) -> DataFrame:
    """docs without those rejected: texts in no learned language (und), null ones among them. Rows, repeated ones too, and columns
    of whatever name are otherwise unchanged; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, path, labelled_docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([lang != UNKNOWN for lang in scorer(b.column("text").to_pylist())[0]], pa.bool_()))

    return map_arrow(docs, keep, ", ".join(f"`{c}` {sql_type(docs, c)}" for c in docs.columns))
