"""Packing of token pieces into sequences: dominance reduction, then best fit.

Piece lengths are whole numbers up to the sequence length, so a packing problem of any size is its histogram: at most
1024 counts. The driver reduces and packs the histogram; sequences of equal content form runs, and every piece finds
its place from its number among the pieces of its length.

The reduction (after Martello and Toth) fixes a set for the longest remaining length s, room c = capacity - s:

* nothing fits beside s: s alone;
* a piece of length c exists: {s, c}, as whatever else shares a sequence with s also fits where that piece was;
* the two shortest others do not fit together: {s, longest that fits};
* the three shortest do not: {s, a} if no two others that fit are together longer than the longest fitting a, or {s, a, b}
  with b the longest beside a if nothing longer than b can be the smaller of two that fit.

It stops fixing s at the first case that none of these decide and goes on with shorter lengths, which stay exact-fit candidates.

Defined cases: a null text is empty and is a piece of its end id alone; repeated rows are packed as often as they occur; a null
id is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.ranks import numbered
from tickscope.llm.tokens import default_path, encoder
from tickscope.sources.workdir import materialize

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"

#: (contents as ((length, times), ...), number of equal sequences)
Run = tuple[tuple[tuple[int, int], ...], int]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece; a text of more than ``capacity`` ids has a first piece of the remainder and then full ones."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(row, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            row, piece, start, length, crc = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(
                start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, PIECES.format(id=dict(docs.dtypes)[id_col]))


class _Counts:
    """Remaining pieces by length, with the lengths in order."""

    def __init__(self, sizes: dict[int, int]):
        self.n = {s: k for s, k in sizes.items() if k}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect_left(self.order, size)]

    def longest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """Longest length up to ``limit`` of which a piece is left besides ``without``."""
        i = bisect_left(self.order, limit + 1) - 1
        while i >= 0 and self.n[self.order[i]] <= without.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def shortest(self, k: int, without: int) -> list[int]:
        """The k shortest pieces besides one of length ``without``."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s] - (s == without), k - len(out))
            if len(out) == k:
                break
        return out


def _dominating(left: _Counts, s: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of s in a set that dominates every other set with s; None if no rule decides."""
    room = capacity - s
    a = left.longest(room, (s,))
    if a is None:
        return ()
    if a == room:
        return (a,)
    short = left.shortest(3, s)
    if len(short) < 2 or short[0] + short[1] > room:
        return (a,)
    if len(short) == 3 and sum(short) <= room:
        return None
    # at most two partners fit: the smaller of two is at most half the room
    small = left.longest(room // 2, (s,))
    widest = 0
    for x in left.order:
        if x * 2 > room:
            break
        if left.n[x] - (x == s) > 0:
            y = left.longest(room - x, (s, x))
            if y is not None and y >= x:
                widest = max(widest, x + y)
    if widest <= a:
        return (a,)
    b = left.longest(room - a, (s, a))
    if b is not None and small is not None and small <= b:
        return (a, b)
    return None


def reduce_sizes(sizes: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Fixed runs and the counts that remain."""
    left, fixed = _Counts(sizes), []
    for s in sorted(left.n, reverse=True):
        while s in left.n:
            partners = _dominating(left, s, capacity)
            if partners is None:
                break
            inside = (s, *partners)
            need = {x: inside.count(x) for x in inside}
            # the decision stays the same while every length of the set is there and none of the shortest runs out
            times = min(left.n[x] // k for x, k in need.items())
            if len(partners) == 2 or (partners and partners[0] != capacity - s):
                times = max(1, min(times, min(left.n[x] // k for x, k in need.items()) - 2))
            for x, k in need.items():
                left.take(x, k * times)
            fixed.append((tuple(sorted(need.items(), reverse=True)), times))
    return fixed, left.n


def best_fit(sizes: dict[int, int], capacity: int) -> list[Run]:
    """Best fit decreasing over counts: bins of equal content move together, so the work depends on lengths, not on pieces."""
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []
    done: list[Run] = []

    def put(contents: tuple[tuple[int, int], ...], times: int, room: int) -> None:
        if not times:
            return
        if room == 0:
            done.append((contents, times))
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((contents, times))

    for s in sorted(sizes, reverse=True):
        k = sizes[s]
        while k:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                full, rest = divmod(k, each)
                put(((s, each),), full, capacity - s * each)
                if rest:
                    put(((s, rest),), 1, capacity - s * rest)
                k = 0
                break
            room = rooms[i]
            contents, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[i]
            each = room // s
            full, rest = divmod(k, each)
            if full >= times:
                put((*contents, (s, each)), times, room - s * each)
                k -= times * each
                continue
            put((*contents, (s, each)), full, room - s * each)
            if rest:
                put((*contents, (s, rest)), 1, room - s * rest)
            put(contents, times - full - (rest > 0), room)
            k = 0
    return done + [x for room in rooms for x in by_room[room]]


def pack_sizes(sizes: dict[int, int], capacity: int) -> list[Run]:
    fixed, rest = reduce_sizes(sizes, capacity)
    return fixed + best_fit(rest, capacity)


def places_of(runs: list[Run]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, pieces per sequence, offset of the first), in order of the numbers."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for contents, times in runs:
        offset = 0
        for s, k in contents:
            out.setdefault(s, []).append((used.get(s, 0), sequence, k, offset))
            used[s] = used.get(s, 0) + k * times
            offset += s * k
        sequence += times
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    The histogram that comes to the driver has ``capacity`` rows at most, and the table of places that goes to the tasks
    depends on lengths only, not on the number of pieces.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer or default_path(), capacity, end_id), "pieces")
    sizes = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = places_of(pack_sizes(sizes, capacity))
    ranked = numbered(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], "number", sum(sizes.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                rows = places[int(s)]
                at = rows[np.searchsorted(rows[:, 0], number[mine], side="right") - 1]
                nth = number[mine] - at[:, 0]
                sequence[mine] = at[:, 1] + nth // at[:, 2]
                offset[mine] = at[:, 3] + nth % at[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place, PIECES.format(id=dict(pieces.dtypes)["doc_id"]) + ", sequence_id long, offset long")
