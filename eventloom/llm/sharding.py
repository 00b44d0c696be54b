"""Shards of near-equal size: indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut, fields, map_arrow, numbered


@dataclass
class _Node:
    room: int
    bin: int
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


def _height(n: _Node | None) -> int:
    return n.height if n else 0


def _fix(n: _Node) -> None:
    n.height = 1 + max(_height(n.left), _height(n.right))


def _lift_left(n: _Node) -> _Node:
    up = n.left
    n.left, up.right = up.right, n
    _fix(n), _fix(up)
    return up


def _lift_right(n: _Node) -> _Node:
    up = n.right
    n.right, up.left = up.left, n
    _fix(n), _fix(up)
    return up


def _level(n: _Node) -> _Node:
    _fix(n)
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _lift_right(n.left)
        return _lift_left(n)
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _lift_left(n.right)
        return _lift_right(n)
    return n


def _put(n: _Node | None, room: int, bin: int) -> _Node:
    if n is None:
        return _Node(room, bin)
    if (room, bin) < (n.room, n.bin):
        n.left = _put(n.left, room, bin)
    else:
        n.right = _put(n.right, room, bin)
    return _level(n)


def _take_first(n: _Node) -> tuple[_Node | None, _Node]:
    if n.left is None:
        return n.right, n
    n.left, first = _take_first(n.left)
    return _level(n), first


def _take(n: _Node, room: int, bin: int) -> _Node | None:
    if (room, bin) == (n.room, n.bin):
        if n.right is None:
            return n.left
        rest, first = _take_first(n.right)
        first.left, first.right = n.left, rest
        return _level(first)
    if (room, bin) < (n.room, n.bin):
        n.left = _take(n.left, room, bin)
    else:
        n.right = _take(n.right, room, bin)
    return _level(n)


@dataclass
class Bins:
    """Bins of one capacity in an AVL tree by remaining room (then number)."""

    capacity: int
    root: _Node | None = None
    rooms: list[int] = field(default_factory=list)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the bin with the least room that still holds size; of equals, the earliest."""
        n, best = self.root, None
        while n:
            if n.room >= size:
                n, best = n.left, (n.room, n.bin)
            else:
                n = n.right
        return best

    def place(self, size: int, count: int) -> list[tuple[int, int]]:
        """Puts count items of one size, each into the tightest bin at its turn; [(bin, how many)] in that order.

        After an item of this size a bin is tighter than it was, so it stays the choice until it can't hold another: a bin's
        share is placed in one step, and the work is bounded by the bins touched, not by the items.
        """
        out = []
        while count:
            if found := self.tightest(size):
                room, bin = found
                self.root = _take(self.root, room, bin)
            else:
                room, bin = self.capacity, len(self.rooms)
                self.rooms.append(room)
            n = min(count, room // size)
            if not n:
                raise ValueError(f"an item of {size} is larger than a bin of {self.capacity}")
            self.rooms[bin] = room - n * size
            self.root = _put(self.root, self.rooms[bin], bin)
            out.append((bin, n))
            count -= n
        return out


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Packs {size: count}; [(size, bin, how many)] in placing order, or None once it takes more than `most` bins."""
    bins, out = Bins(capacity), []
    for size, count in sorted(histogram, reverse=True):
        out += [(size, bin, n) for bin, n in bins.place(size, count)]
        if most is not None and len(bins.rooms) > most:
            return None
    return out


def smallest_capacity(histogram: list[tuple[int, int]], shards: int) -> int:
    """A least capacity at which best fit decreasing needs no more than `shards` bins, found by bisection."""
    total, largest = sum(s * n for s, n in histogram), max((s for s, _ in histogram), default=1)
    low = max(largest, -(-total // shards), 1)
    if best_fit_decreasing(histogram, low, shards) is not None:
        return low
    step = 1
    while best_fit_decreasing(histogram, low + step, shards) is None:
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(histogram, middle, shards) is not None else (middle, high)
    return high


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, gid): UTF-8 bytes plus 8, the unsigned CRC-32, and SHA-256 as the name of the group."""
    text = F.coalesce("text", F.lit(""))
    base = fields(docs, "doc_id", "text")
    return base.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("gid"))


def pack(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every document in a shard, rows of one text together.

    Give `capacity` for as few shards of that many bytes as best fit decreasing needs, or `shards` for that number of shards at
    the smallest capacity it manages, which makes their sizes near equal. slot counts 0, 1, ... within a shard.

    Groups of equal texts are indivisible as long as they fit: one that outweighs the capacity (there are fewer such groups
    than shards) is taken row by row, whatever the rows' ids: its numbered rows are items of their own, and a bin takes as many
    of them at its turn as fit, so they stay together as far as they can. Only the histogram of group sizes comes to the
    driver; distinct sizes whose sum is the table's T bytes number at most sqrt(2 T). The packing names ranks within a size,
    and a distributed numbering by (size, group) turns ranks into groups. A null text has no bytes, size 8; repeated rows
    and null ids are rows like others; columns other than doc_id and text have no effect; an empty table gives no rows.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = docs.sparkSession
    rows = cut(measured(docs)).withColumn("row", F.monotonically_increasing_id())  # of a table that is kept: the same each time
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = capacity or max(1, -(-total // shards))
    groups = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")).withColumn("weight", F.col("copies") * F.col("size"))
    # At most total / limit groups, which is the number of shards, outweigh the limit.
    heavy = groups.where(F.col("weight") > limit).select(F.col("gid").alias("h"))
    heavy = spark.createDataFrame(heavy.collect(), heavy.schema)
    marked = rows.join(F.broadcast(heavy), F.col("gid") == F.col("h"), "left")
    light, dealt = marked.where("h is null").drop("h").withColumn("part", F.lit(0).cast("bigint")), marked.where("h is not null").drop("h")
    rows = light if heavy.isEmpty() else light.unionByName(numbered(dealt, [F.col("row")], F.col("gid"), "part"))
    units = cut(rows.groupBy("gid", "part").agg(F.sum("size").alias("weight")))
    histogram = [tuple(x) for x in units.groupBy("weight").count().collect()]
    largest = max((w for w, _ in histogram), default=1)
    room = max(largest, capacity) if capacity else smallest_capacity(histogram, shards)
    plan, start, at = [], {}, 0
    for size, count in sorted(histogram, reverse=True):
        start[size], at = at, at + count
    for size, bin, n in best_fit_decreasing(histogram, room):
        plan.append((start[size], start[size] + n, bin))
        start[size] += n
    ranked = numbered(units, [F.desc("weight"), F.col("gid"), F.col("part")], F.lit(0), "rank")
    placed = _by_rank(ranked, plan).select("gid", "part", "shard")
    out = rows.join(placed, ["gid", "part"])
    return numbered(out, [F.col("gid"), F.col("doc_id"), F.col("row")], F.col("shard"), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def _by_rank(ranked: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """ranked with the shard of each rank. plan: (from rank, to rank, shard), one for each distinct size and each time a bin fills up within a size."""
    plan = sorted(plan)
    held = ranked.sparkSession.sparkContext.broadcast((np.array([p[0] for p in plan], np.int64), np.array([p[2] for p in plan], np.int32)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, shard = held.value
        for b in batches:
            at = np.searchsorted(low, b.column("rank").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("part"), pa.array(shard[at])], ["gid", "part", "shard"])

    return map_arrow(ranked.select("gid", "part", "rank"), find, "gid binary, part bigint, shard int")
