"""Token ids, packing and token files: round trips, brute force on small instances."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from tickscope.llm import packing, token_files
from tickscope.llm.sharding import best_fit_decreasing
from tickscope.llm.tokens import WordEncoder, default_path
from tickscope.sources.workdir import new_path

TEXTS = [None, "", " ", "  two  spaces ", "line\nline", "\n\n", "a\r\nb", "tab\there", "Word, word. word; don't I'll 12 3.5%", "é ñ ß Ω 漢字 🙂", "x y   z\x1c q",
         "<|endoftext|> a<|endoftext|>b", "end ", " start", "many words " * 3000, "w" * 5000, "Ⅷ ² ½ _a_ a_b", "é éclair"]
DOCS = "doc_id long, text string, start string, n_ids string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("room", [5, 400_000])
def test_memo_gives_the_ids_of_the_whole_text(plain, room):
    enc = WordEncoder(default_path(), room)
    for t in TEXTS * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain(t), t


def test_memo_on_documents(spark, plain):
    enc = WordEncoder(default_path(), 2000)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(enc.encode(r.text), "<u4").tolist() == plain(r.text)


def fewest(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in sorted({r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values()):
            rooms[k] -= sizes[i]
            go(i + 1, rooms)
            rooms[k] += sizes[i]
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def as_counts(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


@pytest.mark.parametrize("low", [1, 4, 6])
def test_reduction_keeps_the_optimum(low):
    rng = random.Random(low)
    for _ in range(150):
        capacity = rng.randint(12, 24)
        sizes = sorted((rng.randint(low, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduce_sizes(as_counts(sizes), capacity)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + fewest(left, capacity) == fewest(sizes, capacity), (sizes, capacity, fixed, rest)


def test_packings_hold_everything_once():
    rng = random.Random(9)
    for _ in range(100):
        capacity = rng.randint(10, 200)
        sizes = {s: rng.randint(1, 400) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(9, capacity)))}
        runs = packing.pack_sizes(sizes, capacity)
        assert all(sum(s * k for s, k in c) <= capacity and n > 0 for c, n in runs)
        got = {}
        for c, n in runs:
            for s, k in c:
                got[s] = got.get(s, 0) + k * n
        assert got == sizes
        one_by_one = best_fit_decreasing({(s, k): s for s, n in sizes.items() for k in range(n)}, capacity)
        assert sum(n for _, n in packing.best_fit(sizes, capacity)) == len(set(one_by_one.values()))


def check_packing(rows, texts, plain, capacity=1024):
    by_doc, room = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in texts.items():
        ids, at = [*plain(t), 2], 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    return len(room)


def test_documents_are_packed(spark, plain):
    texts = dict(enumerate(TEXTS + ["short"] * 300))
    rows = packing.pack_documents(spark.createDataFrame([(i, t, "", "") for i, t in texts.items()], DOCS)).collect()
    used = check_packing(rows, texts, plain)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(1, "a", "", ""), (1, "a", "", ""), (None, "b", "", "")], DOCS)).collect()
    assert sorted((r.offset, r.sequence_id) for r in twice) == sorted({(r.offset, r.sequence_id) for r in twice})


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, letters in itertools.product((1, 2, 50, 5000), (1, 2, 30)):
        ids = rng.integers(0, letters, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n + 1, 4), n))
        symbols, rules, firsts = token_files.repair(ids, ends, 100)
        lengths = token_files.rule_lengths(rules, 100)
        assert token_files.expand(symbols, rules, lengths, 100).tolist() == ids.tolist()
        assert token_files.expand_shard(symbols, rules, lengths, 100).tolist() == ids.tolist()
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            mine = symbols[firsts[k]:firsts[k + 1] if k + 1 < len(firsts) else None]
            assert token_files.expand(mine, rules, lengths, 100).tolist() == ids[a:b].tolist()
            for s, m in ((0, b - a), (1, 2), ((b - a) // 2, 1)):
                assert token_files.expand_range(mine, rules, lengths, 100, s, min(m, b - a - s)).tolist() == ids[a + s:a + s + max(0, min(m, b - a - s))].tolist()
        if n == 5000 and letters < 30:
            assert len(symbols) < n / 2 and all(lengths > 1)


@pytest.mark.parametrize("shard_ids", [100, 1_000_000])
def test_token_files_round_trip(spark, plain, shard_ids):
    rows = [(i * 7, t, "", "") for i, t in enumerate(TEXTS)] + [(None, "nobody", "", ""), (7, "again", "", "")]
    path = new_path(spark, "files")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS).repartition(5), path, shard_ids=shard_ids)
    got = token_files.read_token_files(spark, path).collect()
    want = sorted((((-1 if d is None else d), len(plain(t)) + 1, zlib.crc32(np.array([*plain(t), 0], "<u4").tobytes())) for d, t, _, _ in rows))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    text = TEXTS[14]
    assert token_files.read_document(spark, path, 14 * 7) == [[*plain(text), 0]]
    assert token_files.read_document(spark, path, 14 * 7, 5, 9) == [plain(text)[5:14]]


def test_no_documents_no_files(spark):
    path = new_path(spark, "files")
    token_files.write_token_files(spark.createDataFrame([], DOCS), path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_copies_of_a_long_document_become_single_symbols():
    one = np.random.default_rng(5).permutation(500).astype(np.uint32)
    ids, ends = np.tile(one, 2000), np.arange(1, 2001) * 500
    symbols, rules, firsts = token_files.repair(ids, ends, 1000)
    assert len(symbols) == 2000 and (firsts == np.arange(2000)).all()
    assert (token_files.expand(symbols, rules, token_files.rule_lengths(rules, 1000), 1000) == ids).all()


def plain_repair(ids, ends, base, most):
    """Re-Pair by the book: every round counts all pairs, takes the most frequent ones and walks from left to right."""
    docs = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    rules = []
    while True:
        n = collections.Counter(p for d in docs for p in zip(d, d[1:]))
        taken = sorted(sorted((p for p in n if n[p] >= token_files.LEAST), key=lambda p: (-n[p], p))[:most])
        if not taken:
            return docs, rules
        number = {p: base + len(rules) + k for k, p in enumerate(taken)}
        rules += taken
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                symbol = number.get(tuple(d[i:i + 2]))
                out.append(d[i] if symbol is None else symbol)
                i += 1 if symbol is None else 2
            docs[k] = out


@pytest.mark.parametrize("base, few", [(100, 0), (100, 10**9), (65_530, 0), (70_000, 0)])
def test_counts_kept_between_rounds_give_the_grammar_of_full_counts(monkeypatch, base, few):
    monkeypatch.setattr(token_files, "FEW_PLACES", few)
    rng = np.random.default_rng(4)
    for n, letters, most in itertools.product((40, 900, 4000), (1, 2, 12, 60), (1, 5, 2048)):
        ids = rng.integers(0, letters, n)
        ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        symbols, rules, firsts = token_files.repair(ids, ends, base, most)
        docs, want = plain_repair(ids.tolist(), ends.tolist(), base, most)
        assert [tuple(r) for r in rules.tolist()] == want
        assert symbols.tolist() == [s for d in docs for s in d]
        assert firsts.tolist() == np.cumsum([0, *map(len, docs[:-1])]).tolist()
