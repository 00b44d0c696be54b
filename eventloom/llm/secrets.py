"""Secrets in whole texts: fixed patterns, and literals that reach sensitive names through assignments."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import fields, map_arrow, sql_type
from eventloom.llm.lexing import Constants, lex

#: Fixed patterns and least lengths of the base kinds, in listed order; letters of the names in either case, ASCII only.
_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_EITHER(w) for w in ("password", "passwd", "secret", "token", "api")).replace(_EITHER("api"), _EITHER("api") + "_?" + _EITHER("key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: What a sensitive name holds, in words joined by _, and its weight.
SENSITIVE = (
    (re.compile("pass_?(?:word|wd|phrase|code)|secret(?!ar)|credential|(?:api|access|private|signing|encryption|master)_?key"), 3),
    (re.compile("(?:^|_)pwd(?:_|$)|token(?!i[sz])|bearer"), 2),
    (re.compile("(?:^|_)auth(?:_|$|ori[sz]ation)|signature"), 1),
)
#: Letters that every such name holds, whatever stands between them: a text without them all has none.
_LETTERS = [w.encode() for w in ("password", "passwd", "passphrase", "passcode", "secret", "credential", "apikey", "accesskey", "privatekey", "signingkey", "encryptionkey", "masterkey", "pwd", "token", "bearer", "auth", "signature")]
_OTHERS = bytes(b for b in range(256) if not (48 <= b < 58 or 97 <= b < 123))
#: Weight of the name plus strength of the literal from which a pair counts.
LEAST_SCORE, LEAST_LITERAL = 4.0, 8
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|change_me|example|placeholder|redacted|none|null|true|false|undefined|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the whole matches, leftmost and non-overlapping for each kind, in code points."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return out


def name_weight(name: str) -> int:
    """By the name's words: letters in one case between marks, or from a capital on."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+", "_", name).lower()
    return next((w for pattern, w in SENSITIVE if pattern.search(words)), 0)


def may_have_names(text: str) -> bool:
    """Whether the letters of a sensitive name stand in a row, other characters aside."""
    plain = text.encode("utf-8", "surrogatepass").lower().translate(None, _OTHERS)
    return any(w in plain for w in _LETTERS)


def literal_strength(literal: str) -> float:
    """0 for placeholders and plain short words, up to 4: bits of Shannon entropy a character, more for mixed classes."""
    if len(literal) < LEAST_LITERAL or _PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(4.0, entropy / 2 + 0.5 * (classes - 1) + (0.5 if n >= 20 else 0))


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that are assigned to sensitive names, straight, joined or through names that hold them.

    The span of a literal is where it is written; parts that are joined in one expression have one span, from the first to the
    last. Unquoted values count if they have a digit, in comments just after an equals sign.
    """
    if not may_have_names(text):
        return []
    lexed = lex(text)
    constants, out = None, set()
    for pair in lexed.pairs:
        weight = name_weight(pair.target)
        if not weight:
            continue
        constants = constants or Constants(lexed)
        parts = [p for p in constants.literals(pair) if p.quoted or (any(c.isdigit() for c in text[p.start : p.end]) and (pair.op == "=" or not pair.note))]
        whole = "".join(text[p.start : p.end] for p in parts)
        if "\n" in whole:
            whole = "".join(whole.split())
        if parts and weight + literal_strength(whole) >= LEAST_SCORE:
            own = {id(p) for p in pair.parts}
            inline = [p for p in parts if id(p) in own]
            if inline:
                out.add((inline[0].start, inline[-1].end, "literal"))
            out.update((p.start, p.end, "literal") for p in parts if id(p) not in own)
    return sorted(out)


def find(text: str | None) -> dict[str, list[tuple[int, int, str]]]:
    """base and added spans of one text; an added span that a base span covers is not repeated."""
    text = text or ""
    base = sorted(base_spans(text))
    starts, furthest = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    added = [s for s in literal_spans(text) if not ((k := bisect(starts, s[0])) and furthest[k - 1] >= s[1])]
    return {"base": base, "added": added}


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in b.column("text").to_pylist():
            found = find(text)
            counts = Counter(k for _, _, k in found["base"] + found["added"])
            base, spans = joined(found["base"]), joined(found["base"] + found["added"])
            for col, x in zip(cols, (*(counts[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), spans), strict=True):
                col.append(x)
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts by kind, the digest of the base spans and all spans.

    Narrow: each text is scanned where it is read, whole. A null text counts as empty (no spans, the digest of the empty
    string); null ids, repeated rows and further columns pass without effect; an empty table gives no rows.
    """
    return map_arrow(fields(docs, "doc_id", "text"), _scan, f"doc_id {sql_type(docs, 'doc_id')}, {SCHEMA}")
