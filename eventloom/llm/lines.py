"""Line deduplication across documents, exact and within a few edits, by a segment-partition edit join. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import common
from eventloom.llm.common import cut, fields, release, small
from eventloom.llm.graph import components

#: Edits within which two lines count as one, and the least code points of a line for which edits are forgiven at all.
MAX_EDITS, NEAR_CHARS = 1, 20


def segments(n: str, edits: int) -> list[tuple[str, str]]:
    """SQL for (start from 1, length) of each of the edits + 1 segments of a line of n code points, the last ones longer by one."""
    k = edits + 1
    short = f"({n} div {k})"
    out, start = [], "1"
    for i in range(k):
        length = f"({short} + int({n} % {k} >= {k - i}))"
        out.append((start, length))
        start = f"({start} + {length})"
    return out


def marks(line: str, n: str, edits: int) -> tuple[list[str], list[str]]:
    """SQL for the hashed index entries of a line, one a segment, and for its probes beyond these.

    A line probes the indexes of lines of its own length and of up to `edits` code points less. In an index of shorter lines by
    d, the start of segment i may be off by at most i - 1 edits before it and by at most edits + 1 - i after it, so only
    that many substrings are probed. Those of its own length in place are its index entries themselves.
    """
    mark = lambda length, i, at, size: f"xxhash64({length}, {i}, substring({line}, {at}, {size}))"
    index = [mark(n, i, *seg) for i, seg in enumerate(segments(n, edits), 1)]
    probes = []
    for d in range(edits + 1):
        length = f"({n} - {d})"
        for i, (at, size) in enumerate(segments(length, edits), 1):
            low, high = max(-(i - 1), d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i))
            probes += [mark(length, i, f"({at} + {shift})", size) for shift in range(low, high + 1) if d or shift]
    return index, probes


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether the edit distance of two string columns is at most `edits`: a banded bit-parallel automaton.

    The band has 2 edits + 1 diagonals, a bit each. Row by row of a, state e keeps the diagonals whose cell is reached with at
    most e edits: it moves on along equal characters, and from state e - 1 by a replacement, a deletion (one diagonal down)
    or, within the row, an insertion (one up). The lines match if the diagonal of the two ends is in the last state.
    """
    width = 2 * edits + 1
    masks = "transform(o.a, (x, j) -> " + " + ".join(f"if(coalesce(x = get(o.b, j + {k - edits}), false), {1 << k}L, 0L)" for k in range(width)) + ")"
    start = ", ".join(f"{sum(1 << (edits + i) for i in range(e + 1))}L as r{e}" for e in range(edits + 1))
    new = ["(s.r0 & m)"]
    for e in range(1, edits + 1):
        new.append(f"(((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | shiftleft({new[-1]}, 1)) & {(1 << width) - 1}L)")
    step = ", ".join(f"{x} as r{e}" for e, x in enumerate(new))
    last = f"aggregate({masks}, struct({start}), (s, m) -> struct({step})).r{edits}"
    apart = f"(char_length({b}) - char_length({a}))"
    # The lambda variable o holds the split lines, so that they are split once a pair.
    reached = f"element_at(transform(array(struct(split({a}, '') as a, split({b}, '') as b)), o -> {last}), 1)"
    return F.expr(f"abs{apart} <= {edits} and (shiftrightunsigned({reached}, {apart} + {edits}) & 1L) = 1")


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line_no, line, n, key) of the lines that are compared, all but empty ones; key is the line's MD5, version a hash of its text."""
    lines = fields(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("n", F.char_length("line")).where(F.col("n") > 0)
    return lines.withColumn("key", F.unhex(F.md5(F.col("line").cast("binary"))))


def distinct_lines(lines: DataFrame, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(key, lines, n, e1.., p1..): each line's number of places, and the marks of those of near_chars or more.

    The marks of equal lines are equal, so their maximum names them; only fixed-size values are combined, in each task first."""
    entries, probes = marks("line", "n", max_edits)
    own = {f"e{i}": x for i, x in enumerate(entries)} | {f"p{i}": x for i, x in enumerate(probes)}
    marked = lines.select("key", "n", *(F.expr(f"if(n >= {near_chars}, {x}, null)").alias(c) for c, x in own.items()))
    return marked.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in own))


def links(lines: DataFrame, distinct: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): keys of different lines within max_edits.

    Candidates are lines of which one's probe meets the other's index entry. Marks are first counted, in one shuffle of marks
    alone; most are met by one line only, and lines go on just with the marks that several meet. Entries are per length; a
    bucket with more lines than they have code points (boilerplate that differs in one place) would cost more in pairs than
    in deletions: for max_edits 1 each of its lines is then taken to pieces instead. Lines that are equal without the code
    point at one place are all one replacement apart, so they link to the least of them; a line that equals another without a
    code point links to it. So no bucket is paired off. Larger max_edits verify such buckets in the join, split by its skew
    handling.
    """
    kinds = [c for c in distinct.columns if c[0] in "ep"]
    role = lambda c: F.struct(F.col(c).alias("mark"), F.lit(c[0] == "e").alias("entry"))
    marked = distinct.where(F.col("e0").isNotNull()).select("key", "n", F.explode(F.array(*map(role, kinds))).alias("m")).select("m.mark", "m.entry", "key", "n")
    count = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("met"), F.sum(F.col("entry").cast("int")).alias("entries"), F.max(F.when(F.col("entry"), F.col("n"))).alias("long"))
    met = cut(count.where("met > 1 and entries > 0").select("mark", F.expr(f"{max_edits} = 1 and entries > long").alias("full")))
    several = cut(marked.join(small(met), "mark"))
    found = crowded = None
    if max_edits == 1:
        crowded = cut(several.where("full").select("key").distinct())
        if not crowded.isEmpty():
            found = _by_deletion(lines, crowded)
    live = several.where("not full")
    entry = live.where("entry").select("mark", F.col("key").alias("b"), F.col("n").alias("nb"))
    pairs = live.withColumnsRenamed({"key": "a", "n": "na"}).join(entry, "mark").where(f"if(entry, a < b and na = nb, a != b and na - nb between 0 and {max_edits})").select("a", "b")
    found = cut((pairs if found is None else pairs.unionByName(found)).distinct())
    asked = cut(found.select(F.col("a").alias("key")).unionByName(found.select(F.col("b").alias("key"))).distinct())
    texts = cut(lines.select("key", "line").join(small(asked), "key", "left_semi").dropDuplicates(["key"]))
    both = found.join(texts.withColumnsRenamed({"key": "a", "line": "line_a"}), "a").join(texts.withColumnsRenamed({"key": "b", "line": "line_b"}), "b")
    out = cut(both.where(within_edits("line_a", "line_b", max_edits)).select("a", "b"))
    release(met, several, found, asked, texts, crowded)
    return out


def _by_deletion(lines: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b): enough candidate links among crowded lines to connect all that one edit connects."""
    own = lines.select("key", "line", "n").join(small(crowded), "key", "left_semi").dropDuplicates(["key"])
    less = own.select("key", F.posexplode(F.expr("transform(sequence(1, n), i -> unhex(md5(concat(left(line, i - 1), substring(line, i + 1)))))")).alias("at", "rest"))
    less = cut(less)
    least = less.groupBy("at", "rest").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("lines")).where("lines > 1").select("at", "rest", "b")
    replaced = less.join(least, ["at", "rest"]).where("key != b").select(F.col("key").alias("a"), "b")
    shorter = less.select("key", "rest").distinct().join(crowded.select(F.col("key").alias("rest")), "rest").select(F.col("key").alias("a"), F.col("rest").alias("b"))
    out = cut(replaced.unionByName(shorter).distinct())
    release(less)
    return out


def places(docs: DataFrame, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc_id, version, line_no, key, root, links): every place of a line that repeats, exactly or nearly, with its class and
    how many other lines it links to."""
    lines = split_lines(docs)
    distinct = cut(distinct_lines(lines, max_edits, near_chars))
    linked = links(lines, distinct, max_edits)
    degree = linked.select(F.col("a").alias("key")).unionByName(linked.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    near = degree.join(components(linked, "a", "b").select(F.col("node").alias("key"), "root"), "key")
    repeated = distinct.select("key", "lines").join(near, "key", "left").where("lines > 1 or root is not null")
    repeated = cut(repeated.select("key", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    release(distinct, linked)
    out = cut(lines.select("doc_id", "version", "line_no", "key").join(small(repeated), "key"))
    release(repeated)
    return out


def _judged(docs: DataFrame, own: list[str], max_edits: int, near_chars: int) -> DataFrame:
    """(row, text, gone): the columns `own` of docs as one struct, whose fields no name can clash with, and the later lines of each."""
    found = places(docs, max_edits, near_chars)
    at = F.struct("doc_id", "version", "line_no")
    heads = cut(found.groupBy("root").agg(F.min(at).alias("first")))
    later = found.join(small(heads), "root").where(~at.eqNullSafe(F.col("first")))
    gone = cut(later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("line_no", "links")).alias("gone")))
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    release(found, heads)
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "version": "gone_version"})
    if size[0] + (size[1] or 0) <= common.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct(*(docs[c] for c in own)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_version")), "left")
    return joined.select("row", "text", "gone")


_DROPPED = "exists(gone, g -> g.line_no = i)"
_KEPT = f"if(gone is null, text, array_join(filter(split(text, '\\n'), (x, i) -> not {_DROPPED}), '\\n'))"


def dedup(docs: DataFrame, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with every line removed that occurs before, exactly or within max_edits; text_lines, removed_lines and near_lines are added.

    Lines are split at \\n in whole texts. Empty lines always stay; lines of fewer than near_chars code points repeat exactly or
    not at all, longer ones of any length within max_edits too. Lines linked by edits, over chains too, form a class, and each
    class keeps its first line, by doc_id (null ids first), then a hash of the text, then place. A null text stays null (no
    lines). Rows with equal doc_id and text count as one document: what is first in one is first in the other. An empty table
    gives no rows; added columns replace ones of their names, and no other name can clash.
    """
    own = [c for c in docs.columns if c not in ("text_lines", "removed_lines", "near_lines")]
    out = _judged(docs, own, max_edits, near_chars)
    counts = {
        "text_lines": "if(text is null, 0, size(split(text, '\\n')))",
        "removed_lines": "coalesce(if(gone is null, 0, size(gone)), 0)",
        "near_lines": "coalesce(size(filter(gone, g -> g.links > 0)), 0)",
    }
    counted = [F.expr(f"cast({x} as bigint)").alias(c) for c, x in counts.items()]
    return out.select(*(F.expr(_KEPT).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own), *counted)


def without_repeats(docs: DataFrame, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs as dedup leaves them, in their own columns whatever these are called: n_chars, where there is one, follows the text, and a
    document that loses every line goes. Nulls, repeats and empty tables are as in dedup."""
    out = _judged(docs, docs.columns, max_edits, near_chars).where("gone is null or size(gone) < size(split(text, '\\n'))")
    cols = {c: F.col("row")[c] for c in docs.columns} | {"text": F.expr(_KEPT)}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("gone").isNotNull(), F.char_length(F.expr(_KEPT))).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(x.alias(c) for c, x in cols.items()))
