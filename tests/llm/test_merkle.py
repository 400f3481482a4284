"""Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from tickscope.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _tree string, lo long, root string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r[4] if r[4] is None else r[4] + more
    return h(*map(field, (r[0], r[3], r[2], n, r[1])))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for row in levels[:-1]:
        j = i ^ 1
        out.append((row[j] if j < i else "", row[j] if i < j < len(row) else ""))
        i //= 2
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    keys = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = tree([leaf(r) for r in langs[k]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for i, r in enumerate(langs[k]):
            p = path(trees[k], i) + path(top, at)
            now = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for a, b in p:
                now = h(a, now, b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*[a + b for a, b in p]), now, now == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    full = [(*r, "x", "y", 5, "z") for r in rows]
    return sorted(map(tuple, merkle.proofs(spark.createDataFrame(full, DOCS)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 3, 65, 700])
def test_trees_of_every_shape(spark, n):
    rows = [(i * 3, f"text {i}", "en" if i % 3 else "fr", "s", i) for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), "t" * rng.randrange(3), rng.choice([None, "", "é", "z", "en"]), rng.choice([None, "a"]), rng.choice([None, 1])) for _ in range(200)]
    rows += [(None, None, None, None, None)] * 3 + [(None, "x", "en", "b", 2), (7, "é" * 1000, "日本", "", -4), (9, "a", None, "s", 9), (9, "a", None, "s", 9)]
    want = brute(rows)
    assert got(spark, rows) == want and any(not r[-1] for r in want)


def test_bands_do_not_change_the_tree(spark, monkeypatch):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(90)]
    want = got(spark, rows)
    monkeypatch.setattr(merkle, "BAND", 2)
    assert got(spark, rows) == want


def test_three_by_three(spark, monkeypatch):
    """Runs of three: siblings on both sides, and the fold still gives the root."""
    monkeypatch.setattr(merkle, "FAN", 3)
    monkeypatch.setattr(merkle, "BAND", 2)
    rows = [(i, f"t{i}", "en", "s", None) for i in range(32)]
    docs = spark.createDataFrame([(*r, "x", "y", 5, "z") for r in rows], DOCS)
    hashes = [leaf(r) for r in rows]
    while len(hashes) > 1:
        hashes = [h(*hashes[i:i + 3]) for i in range(0, len(hashes), 3)]
    found = merkle.proofs(docs).collect()
    assert {r.root for r in found} == {hashes[0]} and all(r.verified for r in found)


def test_labels(spark):
    """Nodes of a level cover all ranks once; a parent's interval is that of its children together."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(150)]
    _, forest, _ = merkle.manifest(spark.createDataFrame([(*r, "x", "y", 5, "z") for r in rows], DOCS))
    levels = {}
    for nodes in forest.bands:
        for r in nodes.collect():
            levels.setdefault(r.level, set()).add((r.lo, r.hi))
    assert sorted(levels) == list(range(9))
    for level, spans in levels.items():
        assert sorted(spans) == [(lo, min(lo + 2 ** level, 150)) for lo in range(0, 150, 2 ** level)]


def test_empty(spark):
    assert got(spark, []) == []
