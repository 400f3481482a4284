"""Sharding: indivisible groups into shards of equal bytes by best-fit decreasing.

Groups are rows of equal text, and each is packed by itself. Groups of one size are alike, so what is packed is the histogram of
group sizes: the largest size first, each group into the bin with the tightest remaining room, found in a balanced tree. Bins of
equal room that follow each other are one entry of the tree and move together, which gives the bins that group by group gives. A
group finds its bin from its number among the groups of its size. For a given number of shards the smallest capacity is searched
for which they suffice.

The driver holds the distinct sizes, at most the root of twice all bytes (245,000 at 30 GB), and with a fixed capacity the bins.

Defined cases: a null text has no bytes and is in one group with empty texts; every row counts one byte
more than its text. Repeated rows are rows. A group above the capacity has a shard of its own. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.ranks import numbered
from tickscope.sources.workdir import materialize

#: Groups with more than this part of all rows, at most 4,096, meet their shards in a broadcast join.
HOT = 1 / 4096

#: (size, number of the first group among those of its size, groups per bin, first bin)
Place = tuple[int, int, int, int]


class RoomTree:
    """Balanced (AVL) tree of (room, bin): insert, remove, and the smallest entry not below a bound, each in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(n) -> int:
        return n[3] if n else 0

    def _make(self, key, left, right):
        return (key, left, right, 1 + max(self._height(left), self._height(right)))

    def _balance(self, key, left, right):
        d = self._height(left) - self._height(right)
        if d > 1:
            if self._height(left[1]) < self._height(left[2]):
                m = left[2]
                left = self._make(m[0], self._make(left[0], left[1], m[1]), m[2])
            return self._make(left[0], left[1], self._make(key, left[2], right))
        if d < -1:
            if self._height(right[2]) < self._height(right[1]):
                m = right[1]
                right = self._make(m[0], m[1], self._make(right[0], m[2], right[2]))
            return self._make(right[0], self._make(key, left, right[1]), right[2])
        return self._make(key, left, right)

    def _put(self, n, key):
        if n is None:
            return self._make(key, None, None)
        if key < n[0]:
            return self._balance(n[0], self._put(n[1], key), n[2])
        return self._balance(n[0], n[1], self._put(n[2], key))

    def _cut(self, n, key):
        if key < n[0]:
            return self._balance(n[0], self._cut(n[1], key), n[2])
        if key > n[0]:
            return self._balance(n[0], n[1], self._cut(n[2], key))
        if n[1] is None:
            return n[2]
        if n[2] is None:
            return n[1]
        least = n[2]
        while least[1]:
            least = least[1]
        return self._balance(least[0], n[1], self._cut(n[2], least[0]))

    def insert(self, key) -> None:
        self.root = self._put(self.root, key)

    def remove(self, key) -> None:
        self.root = self._cut(self.root, key)

    def tightest(self, size: int):
        n, found = self.root, None
        while n:
            if n[0][0] >= size:
                n, found = n[1], n[0]
            else:
                n = n[2]
        return found


def best_fit_decreasing(sizes: dict, capacity: int) -> dict:
    """Item to bin, with as few bins of ``capacity`` as best fit finds; an item above the capacity has a bin of its own."""
    tree, bins, out = RoomTree(), 0, {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = tree.tightest(size)
        if at is None:
            at = (max(capacity, size), bins)
            bins += 1
        else:
            tree.remove(at)
        out[item] = at[1]
        tree.insert((at[0] - size, at[1]))
    return out


def fit_counts(counts: dict[int, int], capacity: int, most: int | None = None) -> tuple[list[Place], int] | None:
    """Best fit decreasing over the number of groups of each size: places and the number of bins; None if it takes more than ``most``."""
    tree, times_of, places, bins = RoomTree(), {}, [], 0

    def put(first: int, times: int, room: int) -> None:
        if times and room:
            times_of[first] = times
            tree.insert((room, first))

    for size in sorted(counts, reverse=True):
        left, number = counts[size], 0
        while left:
            at = tree.tightest(size)
            if at is None:
                room, first = max(capacity, size), bins
                times = -(-left // (room // size))
                bins += times
                if most is not None and bins > most:
                    return None
            else:
                tree.remove(at)
                room, first = at
                times = times_of.pop(first)
            each = room // size
            full, rest = divmod(min(left, each * times), each)
            places.append((size, number, each, first))
            put(first, full, room - each * size)
            if rest:
                put(first + full, 1, room - rest * size)
            used = full + (rest > 0)
            put(first + used, times - used, room)
            number += each * full + rest
            left -= each * full + rest
    return places, bins


def into_shards(counts: dict[int, int], shards: int) -> list[Place]:
    """Places under the smallest capacity for which best fit needs at most ``shards`` bins: steps that double, then bisection.

    An equal share and the largest size together always suffice.
    """
    total = sum(s * n for s, n in counts.items())
    low, step = max(-(-total // shards), max(counts, default=0), 1), 1
    high = low
    while (found := fit_counts(counts, high, shards)) is None:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        middle = (low + high) // 2
        now = fit_counts(counts, middle, shards)
        if now is None:
            low = middle + 1
        else:
            found, high = now, middle
    return found[0]


def with_places(groups: DataFrame, counts: dict[int, int], places: list[Place]) -> DataFrame:
    """``group, n, shard`` for groups with their ``number`` among those of their size."""
    sizes = np.array(sorted(counts, reverse=True), dtype=np.int64)
    base = np.cumsum([0, *(counts[int(s)] for s in sizes)], dtype=np.int64)[:-1]
    table = np.array(places, dtype=np.int64).reshape(-1, 4)
    # places come by falling size and rising number, so their first groups in order of all groups rise
    starts = base[np.searchsorted(-sizes, -table[:, 0])] + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("size", "number"))
            nth = base[np.searchsorted(-sizes, -size)] + number
            at = np.searchsorted(starts, nth, side="right") - 1
            shard = table[at, 3] + (nth - starts[at]) // table[at, 2]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("n"), pa.array(shard, pa.int32())], ["group", "n", "shard"])

    return groups.select("group", "n", "size", "number").mapInArrow(place, "group long, n long, shard int")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row: ``shards`` of near equal bytes or, with ``shards=None``, as few
    shards of ``capacity`` bytes as best fit finds.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group")), "sizes")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    sizes = groups.groupBy("size").agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).toArrow()
    counts = dict(zip(sizes["size"].to_pylist(), sizes["groups"].to_pylist()))
    n = sum(sizes["rows"].to_pylist())
    places = into_shards(counts, shards) if shards else fit_counts(counts, capacity)[0]
    placed = materialize(with_places(numbered(groups, "size", ["group"], "number", sum(counts.values())), counts, places), "placed")
    hot = F.col("n") > F.lit(HOT * n)
    common = F.broadcast(placed.where(hot).select("group", "shard"))
    dealt = rows.join(common, "group").unionByName(
        rows.join(common, "group", "left_anti").join(placed.where(~hot).select("group", "shard"), "group"))
    return numbered(dealt, "shard", ["doc_id", "text_crc32"], "slot", n).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
