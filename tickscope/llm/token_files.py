"""Token-id files with Re-Pair grammars.

Documents go to range partitions in the order of their ids. Each task cuts its documents into shards of about ``shard_ids`` ids. A shard is
compressed by Re-Pair: in each round the most frequent pairs of neighbouring symbols that do not cross a document's end become
nonterminals, replaced from left to right. A row of the file table holds one shard:

* ``part, shard``: place in the order of all shards; ``before``: ids of the part's earlier shards; ``n_ids``: ids of the shard;
* ``doc_id``: its documents in order; ``counts``: their ids, each 32 bits; ``firsts``: the place of each document's first symbol;
* ``rules``: pairs of 32-bit symbols, rule r being symbol ``base + r``; ``lengths``: ids that each rule expands to;
* ``body``: symbols, 16 bits each if all fit, else 32 (``wide``).

Any document, or any run of ids inside one, is decoded from its symbols and the expansion lengths alone. Spark writes the table, so tasks
that run twice or are lost leave no partial shard.

Defined cases: a null text is an empty one and has the end id alone; repeated rows are documents of their own; null ids come
first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickscope.llm.tokens import default_path, encoder

SHARD_IDS = 1_000_000
PAIRS_PER_ROUND = 2048
#: Words a generation of a worker's memo: 600,000 of two generations take about 240 MB, and a third less time than half as many.
MEMO_WORDS = 600_000
LEAST = 16  # a rarer pair costs more than it saves
_BUCKETS = 20
FEW_PLACES = 50_000  # searched without a hash table


def _pairs(a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """Pairs of symbols below ``known`` as numbers, 32 bits wide if they fit."""
    if known <= 1 << 16:
        return (a << np.uint32(16)) | b
    return (a.astype(np.uint64) << np.uint64(32)) | b


def _sides(pairs: np.ndarray) -> np.ndarray:
    half = pairs.dtype.type(pairs.dtype.itemsize * 4)
    return np.column_stack([pairs >> half, pairs & ((pairs.dtype.type(1) << half) - pairs.dtype.type(1))]).astype(np.uint32)


def _buckets(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BUCKETS)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)


def _frequent(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are seen ``LEAST`` times, ascending, and how often."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    keys, n = keys[edge[:-1]], np.diff(edge)
    return keys[n >= LEAST], n[n >= LEAST]


def _numbers(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Place of each pair among the sorted ``keys``, -1 if it is none of them."""
    if len(pairs) <= FEW_PLACES:
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return np.where(keys[at] == pairs, at, -1)
    slot = np.full(1 << _BUCKETS, -1, dtype=np.int32)
    of_key, own = _buckets(keys), np.arange(len(keys), dtype=np.int32)
    slot[of_key] = own
    slot[of_key[slot[of_key] != own]] = -2  # several keys share the bucket
    at = slot[_buckets(pairs)]
    again = np.flatnonzero(at == -2)
    at = np.where(keys[at] == pairs, at, -1)
    found = np.minimum(np.searchsorted(keys, pairs[again]), len(keys) - 1)
    at[again] = np.where(keys[found] == pairs[again], found, -1)
    return at


def repair(ids: np.ndarray, ends: np.ndarray, base: int, most: int = PAIRS_PER_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, firsts) of ``ids`` (unsigned 32-bit) whose documents end before ``ends``; ends when no pair is seen ``LEAST`` times.

    A pair never becomes more frequent: a replaced place makes neighbours of its new symbol only, and all places of a pair that was
    replaced are gone. So a round counts only places beside symbols of the round before and places of pairs that it left for lack of room.
    """
    symbols, lasts = ids.astype(np.uint32), ends - 1
    rules = [np.zeros((0, 2), dtype=np.uint32)]
    known = base
    count = np.ones(len(ids), dtype=bool)
    while True:
        count[lasts] = False
        at = np.flatnonzero(count)
        pairs = _pairs(symbols[at], symbols[at + 1], known)
        frequent, n = _frequent(pairs)
        if not len(frequent):
            break
        taken = np.zeros(len(frequent) + 1, dtype=bool)  # the last place is that of rare pairs, numbered -1
        taken[np.lexsort((frequent, -n))[:most]] = True
        keys = frequent[taken[:-1]]
        which = _numbers(frequent, pairs)
        hit = taken[which]
        left = at[(which >= 0) & ~hit] if len(keys) < len(frequent) else at[:0]
        hit = np.flatnonzero(hit)
        at, which = at[hit], (np.cumsum(taken) - 1)[which[hit]]
        # overlapping pairs: of a run of neighbouring places every other one, from the left
        new = np.concatenate([[True], np.diff(at) > 1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - start) % 2 == 0
        at, which = at[chosen], which[chosen]
        symbols[at] = known + which
        known += len(keys)
        rules.append(_sides(keys))
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        lasts = lasts - np.searchsorted(at + 1, lasts, side="right")
        if len(left):
            count[:] = False
            count[left] = True
            count = count[keep]
        else:
            count = np.zeros(len(symbols), dtype=bool)
        at = at - np.arange(len(at))
        count[at] = True
        count[at[at > 0] - 1] = True
    return symbols, np.vstack(rules), np.concatenate([[0], lasts[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses ids and earlier rules only."""
    n: list[int] = []
    for x, y in rules.tolist():
        n.append((n[x - base] if x >= base else 1) + (n[y - base] if y >= base else 1))
    return np.array(n, dtype=np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids of a run of symbols; each step replaces all rules by their two sides."""
    out = symbols.astype(np.uint32)
    while True:
        big = out >= base
        if not big.any():
            return out
        n = 1 + big.astype(np.int64)
        first = np.cumsum(n) - n
        grown = np.empty(int(n.sum()), dtype=np.uint32)
        grown[first] = out
        pair = rules[out[big].astype(np.int64) - base]
        grown[first[big]], grown[first[big] + 1] = pair[:, 0], pair[:, 1]
        out = grown


def expand_shard(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids of all symbols of a shard: every rule is expanded once, then each symbol takes its run of ids."""
    pool = np.concatenate([expand(rules.ravel(), rules, lengths, base), symbols])
    of_rules = np.cumsum(lengths)
    each, source = np.ones(len(symbols), dtype=np.int64), np.arange(len(pool) - len(symbols), len(pool))
    big = np.flatnonzero(symbols >= base)
    rule = symbols[big].astype(np.int64) - base
    each[big], source[big] = lengths[rule], of_rules[rule] - lengths[rule]
    source -= np.cumsum(each) - each
    return pool[np.repeat(source, each) + np.arange(int(each.sum()))]


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a run of symbols: expansion lengths tell which symbols hold them."""
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    each = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= base
    each[big] = lengths[symbols[big].astype(np.int64) - base]
    after = np.cumsum(each)
    i, j = np.searchsorted(after, start, side="right"), np.searchsorted(after, start + n, side="left")
    before = int(after[i - 1]) if i else 0
    return expand(symbols[i:j + 1], rules, lengths, base)[start - before:start - before + n]


FILE = ("part int, shard int, before long, n_ids long, base int, doc_id array<{id}>, counts binary, firsts binary, rules binary, lengths binary, "
        "wide boolean, body binary")


def _shard_row(part: int, shard: int, before: int, docs: list, texts: list[bytes], base: int) -> list:
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    counts = np.array([len(t) // 4 for t in texts], dtype="<u4")
    symbols, rules, firsts = repair(ids, np.cumsum(counts, dtype=np.int64), base)
    wide = bool(len(symbols)) and int(symbols.max()) >= 1 << 16
    return [part, shard, before, len(ids), base, docs, counts.tobytes(), firsts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
            rule_lengths(rules, base).astype("<u4").tobytes(), wide, symbols.astype("<u4" if wide else "<u2").tobytes()]


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                      end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Write the file table of all documents in ascending order of ids."""
    tokenizer = tokenizer or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranged = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = ranged.sparkSession.createDataFrame([], FILE.format(id=dict(own.dtypes)["doc_id"])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MEMO_WORDS)
        base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids, texts, held, kind = [], [], 0, None

        def row() -> pa.RecordBatch:
            values = _shard_row(part, shard, before, ids, texts, base)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(kind), *[pa.binary()] * 4, pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = enc.encode(text) + end
                if texts and held + len(coded) // 4 > shard_ids:
                    yield row()
                    ids, texts, held, shard, before = [], [], 0, shard + 1, before + held
                ids.append(doc)
                texts.append(coded)
                held += len(coded) // 4
        if texts:
            yield row()

    ranged.mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: every document is decoded. ``start`` counts ids over all shards before."""
    files = spark.read.parquet(path)
    # one row per part, that is per writing task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    kind = dict(files.dtypes)["doc_id"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(name)[r]
                counts, firsts, lengths = (np.frombuffer(get(c).as_py(), "<u4").astype(np.int64) for c in ("counts", "firsts", "lengths"))
                rules = np.frombuffer(get("rules").as_py(), "<u4").reshape(-1, 2)
                body = np.frombuffer(get("body").as_py(), "<u4" if get("wide").as_py() else "<u2").astype(np.uint32)
                base, first = get("base").as_py(), get("first_id").as_py()
                ids = memoryview(expand_shard(body, rules, lengths, base).astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([get("doc_id").values, pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(F.broadcast(starts), "part").select(
        "doc_id", "counts", "firsts", "lengths", "rules", "body", "wide", "base", (F.col("part_start") + F.col("before")).alias("first_id")).mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id, start: int = 0, n: int | None = None) -> list[list[int]]:
    """Ids ``start`` to ``start + n`` of the documents with this id, decoding no more than their own symbols."""
    out = []
    for r in spark.read.parquet(path).where(F.array_contains("doc_id", F.lit(doc_id))).toLocalIterator():
        counts, firsts, lengths = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("counts", "firsts", "lengths"))
        rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
        body = np.frombuffer(r["body"], "<u4" if r["wide"] else "<u2").astype(np.uint32)
        for k, d in enumerate(r["doc_id"]):
            if d == doc_id:
                mine = body[firsts[k]:firsts[k + 1] if k + 1 < len(firsts) else None]
                most = int(counts[k]) - start
                out.append(expand_range(mine, rules, lengths, r["base"], start, most if n is None else min(n, most)).tolist())
    return out
