"""Benchmark passages in documents, with edits: q-gram lemma filter and banded alignment.

Texts are compared in lower case with every run of other signs than letters and digits as one space. Benchmark items are cut into
overlapping passages of ``passage`` characters (shorter items are one passage). A document region within k edits of a passage of
m characters keeps at least m - q + 1 - k q of its q-grams, on neighbouring diagonals (place in document less place in passage)
that spread over at most k. Shared q-grams are counted in diagonal bands of width 2 (k + 1) that overlap by half, so some
band holds them all; bands that reach the bound are aligned exactly within the band and its k neighbours.

k is a tenth of the passage, less where the bound would fall under one q-gram.

Defined cases: null and empty texts hold nothing; items with fewer than q characters match nothing; equal items are reported each;
repeated documents are reported as often as they occur. Items with a null id are searched like all others and are reported as one item, the null one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
PASSAGE = 80
ERROR_RATE = 0.1
#: Characters of passages that are searched for in one pass over the documents: the bound of what tasks are sent.
PASS_CHARS = 4_000_000
#: Characters of a document that a task looks at together, and regions that it aligns together.
CHARS_AT_ONCE = 2_000_000
ALIGNED_AT_ONCE = 1024
#: Shared q-grams that are held together; a text that has more, as repetitive ones do, is halved until it has not.
HITS_AT_ONCE = 2_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Code point to its lower-case form, other signs than letters and digits to a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if not ch.isalnum():
            table[c] = 32
        elif len(low := ch.lower()) == 1:
            table[c] = ord(low)
    return table


def normalized(text: str | None) -> np.ndarray:
    """Code points; no space at either end, none beside another."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    c = _plain()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = c == 32
    c = c[~(space & np.concatenate([[True], space[:-1]]))]
    return c[:-1] if len(c) and c[-1] == 32 else c


def gram_hashes(c: np.ndarray) -> np.ndarray:
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(Q):
        h *= np.uint64(1_000_003)
        h += c[i:i + n]
    h *= _PRIME
    return h


def passages_of(text: str | None, passage: int = PASSAGE) -> list[np.ndarray]:
    """Windows that begin every half passage; the last one ends with the item."""
    c = normalized(text)
    if len(c) < Q:
        return []
    starts = sorted({*range(0, max(1, len(c) - passage + 1), max(1, passage // 2)), max(0, len(c) - passage)})
    return [c[s:s + passage] for s in starts]


def edit_budget(m: int, rate: float = ERROR_RATE) -> int:
    return max(0, min(int(m * rate), (m - Q) // Q))


class PassageIndex:
    """Passages by their q-grams."""

    BITS = 22

    def __init__(self, items: list[int], passages: list[np.ndarray], rate: float):
        self.items, self.passages = items, passages
        self.length = np.array([len(p) for p in passages], dtype=np.int64)
        self.budget = np.array([edit_budget(len(p), rate) for p in passages], dtype=np.int64)
        self.needed = self.length - Q + 1 - self.budget * Q
        h = [gram_hashes(p) for p in passages]
        hashes = np.concatenate([*h, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.times = np.unique(hashes[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(h)), [len(x) for x in h])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in h] or [np.zeros(0, np.int64)])[order]
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def _spots(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text with a q-gram of some passage, and that q-gram's number."""
        h = gram_hashes(c)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).view(np.int64)])
        spot = np.searchsorted(self.hashes, h[at])
        hit = self.hashes[np.minimum(spot, len(self.hashes) - 1)] == h[at]
        return at[hit], spot[hit]

    def _hits(self, at: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text, passage, place in the passage of every shared q-gram."""
        n = self.times[spot]
        ends = np.cumsum(n)
        index = np.repeat(self.first[spot] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(at, n), self.owner[index], self.place[index]

    def find(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, distance, start, end) of the best region of each band that holds a passage; places in the normalized text."""
        if not len(self.hashes) or len(c) < Q:
            return []
        at, spot = self._spots(c)
        if self.times[spot].sum() > HITS_AT_ONCE and len(c) > 16 * PASSAGE:
            # the halves overlap by more than a region can be long
            middle = len(c) // 2
            base = middle - 2 * PASSAGE
            return self.find(c[:middle + 2 * PASSAGE]) + [(o, e, start + base, end + base) for o, e, start, end in self.find(c[base:])]
        text, owner, place = self._hits(at, spot)
        shift = int(self.length.max()) + 1
        width = self.budget[owner] + 1
        band = (text - place + shift) // width
        span = (len(c) + shift) + 2
        # bands counted by hash first: most q-grams are in none that could reach its bound
        size = 1 << int(np.clip(4 * len(band), 256, 1 << 20) - 1).bit_length()
        slot = (owner * 7919 + band) & (size - 1)
        many = np.bincount(slot, minlength=size)
        many[1:] += many[:-1].copy()  # a band and the next one share a slot's rows: band b holds what falls to b and b + 1
        many[0] += many[-1]
        need = self.needed[owner]
        some = (many[slot] >= need) | (many[(slot + 1) & (size - 1)] >= need)
        owner, band, place = owner[some], band[some], place[some]
        # every q-gram of a passage counts once per band, however often a repetitive text has it
        both = np.concatenate([owner * span + band, owner * span + band - 1])
        counted = np.unique(both * shift + np.concatenate([place, place])) // shift
        key, n = np.unique(counted, return_counts=True)
        key = key[n >= self.needed[key // span]]
        owner, band = key // span, key % span
        out = []
        for m in np.unique(self.length[owner]):  # passages of one length have one budget and one band width
            mine = owner[self.length[owner] == m]
            k = int(self.budget[mine[0]])
            low = band[self.length[owner] == m] * (k + 1) - shift - k
            for at in range(0, len(mine), ALIGNED_AT_ONCE):
                who = mine[at:at + ALIGNED_AT_ONCE]
                edits, start, end = banded(np.stack([self.passages[o] for o in who]), c, low[at:at + ALIGNED_AT_ONCE], 2 * (k + 1) + 2 * k)
                out += [(int(who[i]), int(edits[i]), int(start[i]), int(end[i])) for i in np.flatnonzero(edits <= k)]
        return out


def banded(patterns: np.ndarray, text: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``patterns``: fewest edits that turn a region of ``text`` into it on the ``width`` diagonals (text place less pattern
    place) from ``low``, and the region's start and end. All rows are aligned together."""
    rows, m = patterns.shape
    n, far = len(text), m + len(text) + 1
    across = np.arange(width)
    diagonals = low[:, None] + across
    places = low[:, None] + np.arange(width + m)
    window = np.where((places >= 0) & (places < n), text[np.clip(places, 0, max(n - 1, 0))].astype(np.int64), -1)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, far)
    origin = diagonals.copy()
    beyond = np.full((rows, 1), far)
    nowhere = np.zeros((rows, 1), dtype=origin.dtype)
    for i in range(1, m + 1):
        used = diagonals + i  # text characters before the end of the row's cells
        step = np.where((used >= 1) & (used <= n), cost + (window[:, i - 1:i - 1 + width] != patterns[:, i - 1:i]), far)
        outside = (used < 0) | (used > n)
        up = np.where(outside, far, np.hstack([cost[:, 1:], beyond]) + 1)
        best = np.minimum(up, step)
        source = np.where(up < step, np.hstack([origin[:, 1:], nowhere]), origin)
        # insertions run along the row: a prefix minimum of cost less column
        level = best - across
        lowest = np.minimum.accumulate(level, axis=1)
        first = np.maximum.accumulate(np.where(level == lowest, across, 0), axis=1)
        cost = np.where(outside, far, np.minimum(lowest + across, far))
        origin = np.take_along_axis(source, first, axis=1)
    at = cost.argmin(axis=1)
    row = np.arange(rows)
    return cost[row, at], origin[row, at], diagonals[row, at] + m


def _search(index: PassageIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                best: dict[int, tuple[int, int, int]] = {}
                many: dict[int, set[int]] = {}
                c = normalized(text)
                for at in range(0, max(1, len(c)), CHARS_AT_ONCE):
                    # parts overlap by more than a region can be long
                    part = c[max(0, at - 4 * PASSAGE):at + CHARS_AT_ONCE]
                    base = max(0, at - 4 * PASSAGE)
                    for owner, edits, start, end in index.find(part):
                        item = index.items[owner]
                        best[item] = min(best.get(item, (edits, start + base, end + base)), (edits, start + base, end + base))
                        many.setdefault(item, set()).add(owner)
                for item in sorted(best, key=lambda i: (i is None, i or 0)):
                    rows.append(row)
                    found.append((item, len(many[item]), *best[item]))
            item, n, edits, start, end = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(
                n, pa.int32()), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "item_id", "n_passages", "edits", "start", "end"])

    return run


def indexes(benchmark: DataFrame, item_col: str, text_col: str, rate: float, pass_chars: int) -> Iterator[PassageIndex]:
    """The benchmark in parts of about ``pass_chars`` characters, dealt by a hash of item and text; one part is on the driver at a time."""
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * chars // pass_chars))  # each character is in two passages
    for k in range(parts):
        items, passages = [], []
        for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toLocalIterator():
            for p in passages_of(r["text"]):
                items.append(r["item_id"])
                passages.append(p)
        yield PassageIndex(items, passages, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``doc_id, item_id, n_passages, edits, start, end``: one row per document and item with a passage in it.

    A benchmark of any size is searched in passes of a bounded size, each one scan of the documents without a shuffle.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, item_id long, n_passages int, edits int, start long, end long"
    out = None
    for index in indexes(benchmark, item_col, item_text_col, rate, pass_chars):
        found = own.mapInArrow(_search(index), schema)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Rows of ``docs`` without a benchmark passage, all columns as they are; nothing is shuffled."""

    def without(index: PassageIndex, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for text in batch.column(at).to_pylist():
                    c = normalized(text)
                    keep.append(not any(index.find(c[max(0, i - 4 * PASSAGE):i + CHARS_AT_ONCE]) for i in range(0, max(1, len(c)), CHARS_AT_ONCE)))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for index in indexes(benchmark, "item_id", "text", rate, pass_chars):
        docs = docs.mapInArrow(without(index, docs.columns.index(text_col)), docs.schema)
    return docs
