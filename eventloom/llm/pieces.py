"""SentencePiece encoding and decoding: Viterbi over a trie of a batch's distinct marked words.

The words of a batch are sorted, which visits their trie depth-first, and the forward states of common prefixes are reused.
For a unigram model a prefix's state is its best score. For a merge (BPE) model summed scores give other pieces than the
model's own, so there the state is the last piece of the prefix's segmentation: merges never cross the borders that a
segmentation keeps, so a row of pieces is the model's just if each two neighbours are what the model makes of their joined
text, and just one last piece fits each prefix. Either way a step looks at the pieces that end there, and the end walks back.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import fields, map_arrow, sql_type

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A run of marks and what follows up to the next mark. No piece crosses from a character to a mark, so words are segmented apart.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CACHED = 500_000


@dataclass
class Vocabulary:
    """pieces: text -> (score, id); bytes_at: byte -> id; texts: id -> what it stands for as UTF-8; merges: a merge model.

    endings has every ending of a piece and whether it is a piece that the model can come to: a step goes back no further."""

    pieces: dict[str, tuple[float, int]]
    bytes_at: list[int]
    texts: list[bytes]
    endings: dict[str, bool]
    merges: bool = True

    @staticmethod
    @lru_cache(4)
    def read(path: str = MODEL, merges: bool = True) -> Vocabulary:
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelled, texts = {}, [0] * 256, []
        for i in range(held.get_piece_size()):
            text = held.id_to_piece(i)
            if held.is_byte(i):
                value = int(text[3:5], 16)
                spelled[value] = i
                texts.append(bytes([value]))
            elif held.is_control(i) or held.is_unknown(i):
                texts.append(b"")
            else:
                pieces[text] = (held.get_score(i), i)
                texts.append(text.encode())
        for text in pieces:
            if MARK in text.lstrip(MARK):
                raise ValueError(f"the piece {text!r} crosses into a mark: words can't be segmented apart")
        endings = {text[i:]: False for text in pieces for i in range(1, len(text))}
        endings |= {text: not merges or merged(text, pieces) == [text] for text in pieces}
        return Vocabulary(pieces, spelled, texts, endings, merges)

    @property
    def byte_score(self) -> float:
        """Of a character spelled as bytes in a unigram model: below any piece's."""
        return min((s for s, _ in self.pieces.values()), default=0.0) - 10


def merged(text: str, pieces: dict[str, tuple[float, int]]) -> list[str]:
    """A short text's pieces in a merge model: the best-scored neighbours join, the leftmost of equals, while their text is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best, at = -math.inf, -1
        for i in range(len(parts) - 1):
            found = pieces.get(parts[i] + parts[i + 1])
            if found is not None and found[0] > best:
                best, at = found[0], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Trie:
    """Segmentations of words that are visited in sorted order. The stack has, for each prefix of the current path, its
    forward score (unigram models), its last piece's start, and that piece; the next word keeps those of the shared prefix."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.path, self.steps = vocabulary, "", 0
        self.stack: list[tuple[float, int, str]] = [(0.0, 0, "")]
        self.least = vocabulary.byte_score
        self.fits: dict[tuple[str, str], bool] = {}

    def visit(self, word: str) -> bytes:
        """The word's ids, as 32-bit numbers."""
        if len(self.fits) > _CACHED:
            self.fits.clear()
        path, shared = self.path, 0
        while shared < len(path) and shared < len(word) and path[shared] == word[shared]:
            shared += 1
        del self.stack[shared + 1 :]
        self.path = word
        step = self._last if self.vocabulary.merges else self._best
        for end in range(shared + 1, len(word) + 1):
            self.stack.append(step(word, end))
        self.steps += len(word) - shared
        ids, end, pieces = [], len(word), self.vocabulary.pieces
        while end:
            _, start, piece = self.stack[end]
            found = pieces.get(piece)
            if found:
                ids.append(found[1])
            else:
                ids += [self.vocabulary.bytes_at[x] for x in reversed(piece.encode("utf-8", "surrogatepass"))]
            end = start
        ids.reverse()
        return array("i", ids).tobytes()

    def _best(self, word: str, end: int) -> tuple[float, int, str]:
        pieces, stack, endings = self.vocabulary.pieces, self.stack, self.vocabulary.endings
        best = (stack[end - 1][0] + self.least, end - 1, word[end - 1 : end])
        for begin in range(end - 1, -1, -1):
            piece = word[begin:end]
            known = endings.get(piece)
            if known is None:
                break
            if known and (score := stack[begin][0] + pieces[piece][0]) > best[0]:
                best = (score, begin, piece)
        return best

    def _last(self, word: str, end: int) -> tuple[float, int, str]:
        stack, endings, fits = self.stack, self.vocabulary.endings, self.fits
        for begin in range(end - 2, -1, -1):
            piece = word[begin:end]
            known = endings.get(piece)
            if known is None:
                break
            if known:
                pair = (stack[begin][2], piece)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = not begin or merged(pair[0] + piece, self.vocabulary.pieces) == [*pair]
                if fit:
                    return 0.0, begin, piece
        return 0.0, end - 1, word[end - 1 : end]


def words_of(text: str) -> list[str]:
    """The marked words of a text: a mark goes before it and stands for each space."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Codec:
    """Encodes texts in batches; segmentations are kept for a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held, self.trie = vocabulary, {}, Trie(vocabulary)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [words_of(t or "") for t in texts]
        new = set().union(*split)
        if len(self.held) > _CACHED:
            self.held.clear()
        held, visit = self.held, self.trie.visit
        for w in sorted(new.difference(held)):
            held[w] = visit(w)
        return [np.frombuffer(b"".join(map(held.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Marks become spaces again, the one in front goes."""
        texts = self.vocabulary.texts
        plain = b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return plain[1:] if plain.startswith(" ") else plain


def normalised(text: str | None) -> str:
    """What decoding gives back: the text itself, but for literal marks, which read as spaces."""
    return (text or "").replace(MARK, " ")


def encode(docs: DataFrame, path: str = MODEL, merges: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_ids bigint, exact boolean), one row for each row of docs; no shuffle.

    ids are the model's own (merge models; with merges=False, those of the highest summed score), characters without a piece
    spelled as UTF-8 bytes; exact tells that decoding the ids gives the text back (a literal mark U+2581 reads as a space). A null text has null ids, 0 of them, and
    is exact; an empty one has an empty array. Words of any length are whole; time is linear in it.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path, merges))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = codec.encode(texts)
            exact = [codec.decode(x) == normalised(t) for x, t in zip(ids, texts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    return map_arrow(fields(docs, "doc_id", "text"), code, f"doc_id {sql_type(docs, 'doc_id')}, ids array<int>, n_ids bigint, exact boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text): the texts of ids; null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(fields(encoded, "doc_id", "ids"), read, f"doc_id {sql_type(encoded, 'doc_id')}, text string")
