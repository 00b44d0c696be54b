"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignment scores the copies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventloom.llm.common import fields, map_arrow, sql_type

#: Words of a seed.
GRAM = 3
MATCH, MISMATCH, GAP = 2, 1, 1
#: Share of the score of a full copy from which a passage counts.
LEAST_SHARE = 0.5
#: Bytes of item text that one broadcast index holds; a larger benchmark is matched in blocks, one pass over the texts for each.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Runs of word characters, each in lower case."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


@dataclass
class Index:
    """Items as word numbers, and seeds: sorted gram keys, and for each where it occurs (item row, offset). short: the items of fewer
    than GRAM words, which match where all their words stand in a row."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: np.ndarray
    first: np.ndarray
    occurs: np.ndarray
    short: dict[int, list[int]]

    @staticmethod
    def of(rows: list[tuple]) -> Index:
        """rows: (item_id, text). Items without a word match nothing."""
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        out = Index([i for i, _ in rows], items, vocabulary, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64), {})
        for k, x in enumerate(items):
            if 0 < len(x) < GRAM:
                out.short.setdefault(len(x), []).append(k)
        keys = [(out.keys(x), k) for k, x in enumerate(items) if len(x) >= GRAM]
        if keys:
            out._hold(np.concatenate([g for g, _ in keys]), np.concatenate([np.column_stack([np.full(len(g), k), np.arange(len(g))]) for g, k in keys]))
        return out

    def _hold(self, grams: np.ndarray, occurs: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.occurs = occurs[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """One number for each gram; -1 where a word is none of the items'. A block's vocabulary is far below 2**21."""
        out = np.zeros(max(0, len(numbers) - GRAM + 1), np.int64)
        known = np.ones(len(out), bool)
        for k in range(GRAM):
            part = numbers[k : k + len(out)]
            out = (out << 21) | part
            known &= part > 0
        return np.where(known, out, -1)

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rows of grams) of the seeds in a text."""
        keys = self.keys(numbers)
        at = np.flatnonzero(keys >= 0)
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        row = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
        same = self.grams[row] == keys[at]
        return at[same], row[same]


    def exact(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item row, first word) of the first place of each short item that stands in a text."""
        for n, rows in self.short.items():
            if len(numbers) < n:
                continue
            runs = sum(numbers[k : len(numbers) - n + 1 + k] << (21 * (n - 1 - k)) for k in range(n))
            names, first = np.unique(runs, return_index=True)
            for k in rows:
                name = int(sum(int(w) << (21 * (n - 1 - i)) for i, w in enumerate(self.items[k])))
                at = int(np.searchsorted(names, name))
                if at < len(names) and names[at] == name:
                    yield k, int(first[at])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, end in item, end in text) of the best local alignment with linear gaps; ends exclusive, the earliest of equals.

    Rows of the Smith-Waterman table are filled at once: a running maximum carries gaps along a row.
    """
    row = np.zeros(len(text) + 1, np.int64)
    slope = GAP * np.arange(len(text) + 1)
    best = (0, 0, 0)
    for i, word in enumerate(item, 1):
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where((text == word) & (word > 0), MATCH, -MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best


def at_most(item: np.ndarray, text: np.ndarray) -> int:
    """A bound of align's score: a text word inside an alignment adds MATCH at most, and takes MISMATCH or GAP if it is none of the item's."""
    total = np.append(0, np.cumsum(np.where(np.isin(text, item), MATCH, -min(MISMATCH, GAP))))
    return int((total - np.minimum.accumulate(total)).max())


def leaks(index: Index, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item row, share of a full copy's score, start, end) in code points: the best passage for each item that reaches LEAST_SHARE."""
    words = words_of(text)
    numbers = index.numbers(words)
    at, rows = index.hits(numbers)
    exact = list(index.exact(numbers)) if index.short else []
    if not len(at) and not exact:
        return []
    windows: dict[int, list[tuple[int, int]]] = {}
    for p, g in zip(at.tolist(), rows.tolist(), strict=True):
        for k, offset in index.occurs[index.first[g] : index.first[g + 1]].tolist():
            n = len(index.items[k])
            windows.setdefault(k, []).append((max(0, p - offset - n // 2), min(len(numbers), p - offset + n + n // 2)))
    out = [(k, 1.0, a, a + len(index.items[k])) for k, a in exact]
    for k, found in windows.items():
        item, best = index.items[k], (0, 0, 0)
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            if at_most(item, numbers[a:b]) < LEAST_SHARE * MATCH * len(item):
                continue
            score, i, j = align(item, numbers[a:b])
            if score > best[0]:
                back = align(item[:i][::-1], numbers[a : a + j][::-1])
                best = (score, a + j - back[2], a + j)
        if best[0] >= LEAST_SHARE * MATCH * len(item):
            out.append((k, best[0] / (MATCH * len(item)), best[1], best[2]))
    spans = [m.span() for m in _WORD.finditer(text)] if out else []
    return sorted((k, share, spans[a][0], spans[b - 1][1]) for k, share, a, b in out)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items' (item_id, text), dealt by hash into blocks of about `block_bytes`; as many as the measured size needs."""
    own = fields(items, "item_id", "text").where("text is not null")
    size = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start, end): each text's best copy of each item that it holds, and nothing for clean texts.

    One narrow pass over the texts for each block of items looks up every n-gram of the items and aligns the words around
    the hits, so a copy is met if it keeps any GRAM words in a row; an item of fewer words is met where all of them stand in
    a row. No text is shuffled, and long ones are searched whole. start and end are code points of the text as it is.
    Null and empty texts hold nothing; a null doc_id or item_id is carried as it is; repeated rows and items are reported
    each; other columns have no effect; an empty table, or one without items, gives no rows.
    """
    base = fields(docs, "doc_id", "text")
    kinds = f"doc_id {sql_type(docs, 'doc_id')}, item_id {sql_type(items, 'item_id')}, score double, start bigint, end bigint"
    ids, out = to_arrow_type(items.schema["item_id"].dataType), None
    for rows in blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Index.of(rows))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                found = [(d, index.ids[k], *rest) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, *rest in leaks(index, t)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field("doc_id").type, ids, pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "score", "start", "end"])

        part = map_arrow(base, search, kinds)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the texts that hold a copy of an item; other rows, repeated and null ones too, and all columns, whatever their
    names, as they are; no shuffle. An empty table, or one without items, stays as it is."""
    out = docs
    for rows in blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Index.of(rows))

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                yield b.filter(pa.array([not leaks(index, t) for t in b.column("text").to_pylist()], pa.bool_()))

        out = map_arrow(out, keep, ", ".join(f"`{c}` {sql_type(docs, c)}" for c in docs.columns))
    return out
