"""Personal data: validated values in whole texts, replaced by format-preserving pseudonyms from a keyed Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
import unicodedata
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import fields, map_arrow, sql_type

ROUNDS = 10
#: The session setting that holds the secret key as text, and the published one that the registered query takes without it:
#: good for tests alone. The operator itself has no default.
KEY_SETTING, DEMONSTRATION_KEY = "spark.eventloom.pii.key", "eventloom-demonstration-key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "iban", "card", "phone", "ssn", "ipv4", "date")


def permute(value: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse.

    A Feistel network over range(a) x range(b), where a * b is the least such product at or above size, adds keyed hashes of
    one half to the other; results outside the range are put in again until one is inside (each walk stays on its cycle).
    """
    if size < 2:
        return value
    a = max(2, math.isqrt(size - 1) + 1)
    b = -(-size // a)
    wide, x = a.bit_length() // 8 + 9, value
    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            even = i % 2 == 0
            source = right if even else left
            f = int.from_bytes(_hashed(b"%d:%x:%x:" % (i, size, source) + tweak, key, wide), "big")
            f = -f if back else f
            if even:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = left * b + right
        if x < size:
            return x


def _hashed(message: bytes, key: bytes, size: int) -> bytes:
    """`size` bytes of a keyed hash, in blocks of 64."""
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    if size <= 64:
        return hashlib.blake2b(message, key=key, digest_size=size).digest()
    return b"".join(hashlib.blake2b(message, key=key, salt=k.to_bytes(16, "big")).digest() for k in range(1, -(-size // 64) + 1))[:size]


def luhn_digit(digits: str) -> str:
    """The check digit that completes digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in (account + country + "00").upper())
    return f"{98 - int(number) % 97:02d}"


def _cased(c: str) -> bool:
    """Whether a lower-case character has one upper-case one that leads back to it."""
    up = c.upper()
    return len(up) == 1 and up != c and up.lower() == c


@lru_cache(1 << 14)
def class_of(c: str) -> str | None:
    """The characters that may stand for c, c among them: ASCII digits, lower or upper case, or for other letters and numbers
    those of the same general category and casing within the same 256 code points. None for other characters, which stay."""
    for plain in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        if c in plain:
            return plain
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return None
    start = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(start, 128), start + 256)) if unicodedata.category(x) == kind and _cased(x) == _cased(c))


def permute_chars(text: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Digits and letters of any script each within their class, all places at once; other characters stay."""
    places = [(i, c) for i, ch in enumerate(text) if (c := class_of(ch))]
    value = size = 0
    for i, c in places:
        value, size = value * len(c) + c.index(text[i]), (size or 1) * len(c)
    if not places:
        return text
    shape = "".join(c[0] for _, c in places).encode()
    value = permute(value, size, key, tweak + shape, back)
    out = list(text)
    for i, c in reversed(places):
        value, d = divmod(value, len(c))
        out[i] = c[d]
    return "".join(out)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _refill(text: str, digits: str) -> str:
    given = iter(digits)
    return "".join(next(given) if c in string.digits else c for c in text)


def _email(m: re.Match, key: bytes, back: bool) -> str:
    """The address in lower case is permuted but for its last label; capitals stand where they stood."""
    upper = [_cased(c.lower()) and c != c.lower() for c in m[0]]
    name, _, last = "".join(c.lower() if up else c for c, up in zip(m[0], upper, strict=True)).rpartition(".")
    new = f"{permute_chars(name, key, b'email', back)}.{last}"
    return "".join(c.upper() if up else c for c, up in zip(new, upper, strict=True))


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    digits = _digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permute_chars(digits[:-1], key, b"card", back)
    return _refill(m[0], body + luhn_digit(body))


# Characters of an IBAN by country, from the public registry.
_IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _IBAN_LENGTHS.split()}


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if len(plain) != IBAN_LENGTHS.get(country, len(plain)) or not 11 <= len(account) <= 30 or iban_check(country, account) != check:
        return None
    account = permute_chars(account, key, b"iban" + country.encode(), back)
    given = iter(country + iban_check(country, account) + account)
    return "".join(c if c == " " else next(given) for c in m[0])


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    head = m["head"] or ""
    digits = _digits(m[0][len(head) :])
    if not 9 <= len(_digits(m[0])) <= 15 or not 7 <= len(digits) <= 14:
        return None
    return head + _refill(m[0][len(head) :], permute_chars(digits, key, b"phone", back))


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, (m[1], m[2], m[3]))
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return None
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, len(areas) * 99 * 9999, key, b"ssn", back), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    named = m.groupdict()
    form = next(f for f in ("iso", "dmy", "mdy") if named[f])
    mark, fields = re.search(r"\D", m[0])[0], [int(x) for x in re.split(r"\D", m[0])]
    order = {"iso": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}[form]
    try:
        day = datetime.date(*(fields[i] for i in order)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", back))
    values = {"iso": (new.year, new.month, new.day), "dmy": (new.day, new.month, new.year), "mdy": (new.month, new.day, new.year)}[form]
    return mark.join(f"{v:04d}" if v > 31 else f"{v:02d}" for v in values)


#: (kind, pattern, replacement or None where the value is not valid), tried in this order; earlier kinds keep their place.
FINDERS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(r"(?<![\w.%+\-@])[\w.%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(r"(?<![0-9./\-])(?:(?P<iso>[0-9]{4}-[0-9]{2}-[0-9]{2})|(?P<dmy>[0-9]{2}(?P<s>[./])(?:0[1-9]|1[0-2])(?P=s)[0-9]{4})|(?P<mdy>[0-9]{2}/[0-9]{2}/[0-9]{4}))(?![0-9]|[./\-][0-9])"), _date),
    ("ssn", re.compile(r"(?<![0-9\-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9\-])"), _ssn),
    ("ipv4", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _ipv4),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20\-]?[0-9]){12,18}(?![0-9A-Za-z])"), _card),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:(?P<head>\+[0-9]{1,3}[\x20.\-]?)(?:\([0-9]{1,4}\)[\x20.\-]?)?|\([0-9]{3}\)[\x20.\-]?|(?=[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])))[0-9]{2,4}(?:[\x20.\-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])"), _phone),
)


@dataclass
class Found:
    start: int
    end: int
    kind: str
    pseudonym: str


#: Layouts of card numbers that are tried before longer runs, in digits a group.
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5))


def _ends(kind: str, run: str) -> list[int]:
    """Where a value that starts a run of groups may end: at usual card layouts or after a sole block first, then the longest first."""
    borders = [i for i, c in enumerate(run) if c in " -"] + [len(run)]
    usual = [e for e in borders if kind == "card" and ("-" not in run[:e] and " " not in run[:e] or tuple(map(len, re.split(r"[ \-]", run[:e]))) in LAYOUTS)]
    return usual + [e for e in reversed(borders) if e not in usual]


@dataclass
class _Taken:
    """Values that are found, without overlap, in order of their starts."""

    starts: list[int] = field(default_factory=list)
    found: list[Found] = field(default_factory=list)

    def free(self, a: int, b: int) -> bool:
        """Whether no value has a place in a to b: only the last one that starts before b can."""
        at = bisect(self.starts, b - 1)
        return not at or self.found[at - 1].end <= a

    def add(self, f: Found) -> None:
        at = bisect(self.starts, f.start)
        self.starts.insert(at, f.start)
        self.found.insert(at, f)


def _find_in_runs(text: str, kind: str, pattern: re.Pattern, replace: Callable, key: bytes, back: bool, out: _Taken) -> None:
    """Adds cards or IBANs: a run may go on over words and numbers beside the value, so its groups are tried from each start to each end."""
    at = 0
    while m := pattern.search(text, at):
        a, b = m.span()
        at = next((i + 1 for i in range(a, b) if text[i] in " -"), b)
        for e in _ends(kind, m[0]):
            part = pattern.fullmatch(text, a, a + e)
            if part is None or not out.free(a, a + e):
                continue
            new = replace(part, key, back)
            if new is not None:
                out.add(Found(a, a + e, kind, new))
                at = a + e
                break


def find(text: str | None, key: bytes, back: bool = False) -> list[Found]:
    """Valid values in text order, in code points, with their pseudonyms."""
    if not text or not any(c in text for c in "0123456789@"):
        return []
    out = _Taken()
    for kind, pattern, replace in FINDERS:
        if kind == "email" and "@" not in text:
            continue
        if kind in ("card", "iban"):
            _find_in_runs(text, kind, pattern, replace, key, back, out)
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if out.free(a, b) and (new := replace(m, key, back)) is not None:
                out.add(Found(a, b, kind, new))
    return out.found


def replaced(text: str, found: list[Found]) -> str:
    parts, at = [], 0
    for f in found:
        parts += [text[at : f.start], f.pseudonym]
        at = f.end
    return "".join([*parts, text[at:]])


def pseudonymised(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, n_<kind> bigint..., spans): each text with its valid values replaced, one row for each row of docs.

    Narrow and without state: a pseudonym depends on the value and the key alone, so equal values stay equal everywhere, and
    one that is written with other separators or, for addresses, other capitals gets the same characters. Check digits,
    separators, letter and digit places are kept, so pseudonyms are valid values of their format. spans: kind:start:end of the values in the old text, code points,
    comma-joined. A null text stays null with no spans; null ids and repeated rows are rows like others, columns
    other than doc_id and text have no effect, texts of any length are read whole, and an empty table gives no rows.
    """
    names = [f"n_{k}" for k in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, spans = [], [], []
            for text in b.column("text").to_pylist():
                found = find(text, key, back)
                texts.append(replaced(text, found) if found else text)
                counts.append(Counter(f.kind for f in found))
                spans.append(",".join(f"{f.kind}:{f.start}:{f.end}" for f in found))
            cols = [b.column("doc_id"), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", *names, "spans"])

    return map_arrow(fields(docs, "doc_id", "text"), scan, f"doc_id {sql_type(docs, 'doc_id')}, text string, {', '.join(f'{n} bigint' for n in names)}, spans string")
