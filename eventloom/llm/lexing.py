"""Assignments in source code and configuration: targets, the literals that reach them, and where those are written.

A text is lexed once, from left to right. Strings (also over several lines), comments, names, operators, blocks and simple
markup are told apart, so that a mark inside a string or a comment is none. Each assignment binds its target in the block where
it stands; names in values are looked up afterwards, so a constant may be defined below its use.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from dataclasses import dataclass, field

#: So many names are followed from one target, so that chains of any length take linear time.
FOLLOWED = 20
_STRING = r""""(?:[^"\\\n]|\\.)*(?P<shut>"?)|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*(?P<shut1>'?)|`(?:[^`\\\n]|\\.)*(?P<shut2>`?)"""
_INNER = rf"""(?P<text>{_STRING})|<(?P<element>[A-Za-z_][\w.:\-]*)(?:[ \t][^<>\n]*)?>(?P<inner>[^<>\n]*)</(?P=element)>|(?P<name>[A-Za-z_$][\w.$\-]*)"""
_LEX = re.compile(rf"""(?P<long>\"\"\"|'''|/\*|<!--)|(?P<note>(?<![^\s;{{(,])(?:\#|//)[^\n]*)|{_INNER}|(?P<mark>[{{}}\n])""")
_LEX_NOTE = re.compile(_INNER)
_CLOSING = {'"""': '"""', "'''": "'''", "/*": "*/", "<!--": "-->"}
#: What may follow a target: an index or a closing quote, a type, an operator.
_OP = re.compile(r"(?:\[(?P<index>[^\]\n]{0,80})\]|\])?[ \t]*(?P<op>:=|=>|=(?![=~])|:(?![:/]))[ \t]*")
_TYPE = re.compile(r"&?(?:'[a-z]+ )?[A-Za-z_*\[][\w.:<>\[\],|?*&]{0,80}[ \t]*=(?![=>])[ \t]*")
_PLAIN_TYPES = {"string", "str", "text", "char", "bytes", "varchar"}
_QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:(?P<long>\"\"\"|''')|"(?P<a>(?:[^"\\\n]|\\.)*)"|'(?P<b>(?:[^'\\\n]|\\.)*)'|`(?P<c>(?:[^`\\\n]|\\.)*)`)""")
_REF = re.compile(r"\$?\{{0,2}[ ]?(?P<name>[A-Za-z_][\w.]*)[ ]?\}{0,2}")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_JOIN = re.compile(r"[ \t]*(?:\\\n[ \t]*)?(?P<op>\+|\.{1,2}(?![\w.])|&|\|\|)[ \t]*(?:\\?\n[ \t]*)?")
_NEXT = re.compile(r"""[ \t]*(?:\\\n[ \t]*)?(?=[rRbBuUfF]{0,2}["'])""")
_NEXT_IN_PARENTHESES = re.compile(r"""\s*(?=[rRbBuUfF]{0,2}["'])""")
_BLOCK = re.compile(r"[|>][+\-]?[ \t]*\n")
_INDENT = re.compile(r"[ \t]*")
_DEFINES = re.compile(r"(?:async[ \t]+)?(?:def|class)\b[^\n]*:[ \t]*(?:#[^\n]*)?(?=\n|$)")


@dataclass
class Part:
    """A literal's place, or a name that stands for others. quoted: whether quotes or a block mark it as text."""

    start: int
    end: int
    name: str = ""
    quoted: bool = True


@dataclass
class Pair:
    target: str
    parts: list[Part]
    scope: int
    at: int
    op: str
    note: bool = False


@dataclass
class Lexed:
    """All assignments of a text in order; parents: scope -> the scope around it (-1 for none)."""

    pairs: list[Pair] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.out = text, Lexed()
        self.open: list[tuple[int, int | None]] = [(0, None)]  # scope, indent of a block that ends by indentation
        self.unclosed: set[str] = set()
        self.keyed: tuple[str, int] | None = None  # what a key="..." attribute names, and where it ends

    def read(self) -> Lexed:
        text, at, line = self.text, 0, 0
        while m := _LEX.search(text, at):
            at = m.end()
            kind = m.lastgroup if m.lastgroup in ("long", "note", "mark") else "inner"
            if kind == "long":
                at = self.long(m)
            elif kind == "note":
                self.notes(m.start() + 1, m.end())
            elif kind == "inner":
                at = self.inner(m, self.open[-1][0], False)
            elif m[0] == "{":
                self.enter(None)
            elif m[0] == "}":
                self.leave()
            else:
                line = self.line(at)
                at = max(at, line)
        return self.out

    def enter(self, indent: int | None) -> None:
        self.out.parents.append(self.open[-1][0])
        self.open.append((len(self.out.parents) - 1, indent))

    def leave(self) -> None:
        """Back to before the innermost brace; without one, nothing."""
        if any(indent is None for _, indent in self.open[1:]):
            while self.open.pop()[1] is not None:
                pass

    def line(self, at: int) -> int:
        """A new line begins: blocks that are indented deeper end, a definition opens one."""
        begin = _INDENT.match(self.text, at).end()
        if self.text[begin : begin + 1] in ("", "\n"):
            return begin
        while len(self.open) > 1 and (indent := self.open[-1][1]) is not None and begin - at <= indent:
            self.open.pop()
        if d := _DEFINES.match(self.text, begin):
            self.enter(begin - at)
            return d.end()
        return begin

    def long(self, m: re.Match) -> int:
        opening = m[0]
        end = -1 if opening in self.unclosed else self.text.find(_CLOSING[opening], m.end())
        if end < 0:
            self.unclosed.add(opening)
            return m.end()
        if opening in ("/*", "<!--"):
            self.notes(m.end(), end)
        return end + len(_CLOSING[opening])

    def notes(self, start: int, end: int) -> None:
        """Pairs in a comment: they see no constants and are none."""
        at = start
        while (m := _LEX_NOTE.search(self.text, at, end)) and m.end() <= end:
            at = max(m.end(), min(end, self.inner(m, -1, True)))

    def inner(self, m: re.Match, scope: int, note: bool) -> int:
        if m["element"] is not None:
            a, b = m.span("inner")
            self.add(m["element"], [Part(a, b, quoted=False)] if a < b else [], scope, a, ">", note)
            return m.end()
        if m["name"] is None:
            whole = m["text"]
            if len(whole) < 2 or whole[-1] != whole[0]:
                return m.end()
            target, at = whole[1:-1], m.end()
            return self.value(target, at, scope, note) if re.fullmatch(r"[\w.$\- ]{1,80}", target) else at
        target = m["name"]
        if target in _PLAIN_TYPES and (before := re.search(r"([A-Za-z_]\w{0,80})[ \t]$", self.text[max(0, m.start() - 90) : m.start()])):
            target = before[1]
        return self.value(target, m.end(), scope, note)

    def value(self, target: str, at: int, scope: int, note: bool) -> int:
        """Reads what is assigned, if an operator follows; returns where lexing goes on."""
        op = _OP.match(self.text, at)
        if not op:
            return at
        if op["index"] and (key := re.fullmatch(r"""["']([\w.$\- ]+)["']""", op["index"])):
            target = key[1]
        begin = op.end()
        typed = _TYPE.match(self.text, begin) if op["op"] == ":" else None
        parts, end = self.parts(typed.end() if typed else begin)
        if typed and (word := re.match(r"[A-Za-z_]\w*", typed[0])):
            self.add(word[0], parts, scope, at, "=", note)  # or a label stands before the target
        self.add(target, parts, scope, at, op["op"], note)
        return parts[-1].start if parts and parts[-1].name else end  # a name may be a target itself

    def add(self, target: str, parts: list[Part], scope: int, at: int, op: str, note: bool) -> None:
        if not parts:
            return
        one = self.text[parts[0].start : parts[0].end]
        if target.lower() in ("key", "name", "id") and len(parts) == 1 and parts[0].quoted:
            self.keyed = (one, parts[0].end)
        elif target.lower() == "value" and self.keyed and at - self.keyed[1] < 40 and "\n" not in self.text[self.keyed[1] : at]:
            target, self.keyed = self.keyed[0], None
        self.out.pairs.append(Pair(target, parts, scope, at, op, note))

    def parts(self, at: int) -> tuple[list[Part], int]:
        """The operands of a concatenation, and the end of the last. A call's result is none, so it gives no part."""
        text = self.text
        if block := _BLOCK.match(text, at):
            return self.block(block.end())
        opened = text[at : at + 1] == "("
        if opened:
            at = re.compile(r"\(\s*").match(text, at).end()
        out: list[Part] = []
        while True:
            q = _QUOTED.match(text, at)
            if q and q["long"]:
                close = text.find(q["long"], q.end()) if q["long"] not in self.unclosed else -1
                if close < 0:
                    self.unclosed.add(q["long"])
                    return out, q.end()
                out.append(Part(q.end(), close))
                at = close + 3
            elif q:
                out.append(Part(*next(q.span(g) for g in "abc" if q[g] is not None)))
                at = q.end()
            elif (bare := _BARE.match(text, at)) or (bare := _REF.match(text, at)):
                ref = _REF.match(text, at)
                whole = ref and (ref.end() >= bare.end() or text[ref.end()] in "+&")
                if whole and text[ref.end() : ref.end() + 1] not in ("(", "["):
                    out.append(Part(*ref.span("name"), ref["name"], False))
                    at = ref.end()
                elif whole or out or text[bare.end() : bare.end() + 1] == "(":
                    return out, bare.end()
                else:
                    end = bare.end()
                    while end > bare.start() and text[end - 1] in ".:!?|":
                        end -= 1
                    return [Part(at, end, quoted=False)] if end > at else [], bare.end()
            else:
                return out, at
            if join := _JOIN.match(text, at):
                at = join.end()
            elif q and (near := (_NEXT_IN_PARENTHESES if opened else _NEXT).match(text, at)):
                at = near.end()
            else:
                return out, at

    def block(self, at: int) -> tuple[list[Part], int]:
        """A block of lines that are indented deeper than the first line's border; blank ones belong to it."""
        text, first, last = self.text, None, at
        border = _INDENT.match(text, at).end() - at
        if not border:
            return [], at
        while at < len(text):
            begin = _INDENT.match(text, at).end()
            end = text.find("\n", begin)
            end = len(text) if end < 0 else end
            if begin < end:
                if begin - at < border:
                    break
                first, last = (begin if first is None else first), end
            at = end + 1
        return ([Part(first, last)] if first is not None else []), last


def lex(text: str) -> Lexed:
    return _Reader(text).read()


class Constants:
    """What names stand for: in a block, the last binding before the use, else the first after it; else in the block around."""

    def __init__(self, lexed: Lexed) -> None:
        self.parents = lexed.parents
        self.bound: dict[str, dict[int, tuple[list[int], list[Pair]]]] = defaultdict(dict)
        for p in lexed.pairs:
            if not p.note:
                at, held = self.bound[p.target].setdefault(p.scope, ([], []))
                at.append(p.at)
                held.append(p)

    def binding(self, name: str, scope: int, at: int) -> Pair | None:
        for own in dict.fromkeys((name, name.rpartition(".")[2])):
            scopes, here = self.bound.get(own), scope
            while scopes and here >= 0:
                if here in scopes:
                    places, pairs = scopes[here]
                    k = bisect(places, at - 1)
                    after = bisect(places, at)
                    return pairs[k - 1] if k else pairs[after] if after < len(pairs) else None
                here = self.parents[here]
        return None

    def literals(self, pair: Pair) -> list[Part]:
        """The literals that reach a target, straight or through names (FOLLOWED at most); a name without a binding is left as it
        is written."""
        out, todo, seen = [], list(reversed([(x, pair) for x in pair.parts])), {id(pair)}
        while todo:
            part, owner = todo.pop()
            if not part.name or len(seen) > FOLLOWED:
                out.append(part)
                continue
            found = None if owner.note else self.binding(part.name, owner.scope, owner.at)
            if found is None:
                out.append(part)
            elif id(found) not in seen:
                seen.add(id(found))
                todo += reversed([(x, found) for x in found.parts])
        return out
