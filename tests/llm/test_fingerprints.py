"""Consistent weighted sampling against a loop over all terms, and its collision rate against the similarity it estimates."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickscope.llm import fingerprints as fp

DOCS = "doc_id long, text string, fingerprint string, _block int, _text string"
M64 = (1 << 64) - 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], DOCS)


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value & M64).to_bytes(8, "little"), seed)


def int_hash(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def words_of(text, k):
    each = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w] or [""]
    return each if k == 1 else [" ".join(each[i:i + k]) for i in range(max(1, len(each) - k + 1))]


def brute(text, k=1, samples=fp.SAMPLES):
    """Every function of every term, without the bound that spares most of them."""
    bag = Counter(xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text, k))
    out = []
    for d in range(samples):
        least = None
        for term, w in bag.items():
            h, g = (int_hash(2 * d + i, long_hash(term, 42)) for i in (0, 1))
            q = ((h >> 32) + 0.5) * ((h & 0xFFFFFFFF) + 0.5) * 2.0 ** -64
            x = ((g >> 43) + 0.5) * (((g >> 22) & 0x1FFFFF) + 0.5) * 2.0 ** -42
            b = ((g & 0x3FFFFF) + 0.5) * 2.0 ** -22
            r = -math.log(x)
            t = math.floor(math.log(w) / r + b)
            a = -math.log(q) * math.exp(r * (b - t - 1))
            signed = term - (1 << 64) if term >> 63 else term
            code = (signed ^ (signed >> 24) ^ (t * 0x9E3779)) & 0xFFFFFF
            least = min(least or (math.inf, 0), (a, code))
        out.append(f"{least[1]:06x}")
    return "".join(out)


def jaccard(a, b):
    a, b = Counter(words_of(a, 1)), Counter(words_of(b, 1))
    return sum((a & b).values()) / sum((a | b).values())


def texts(n, seed=1):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(names, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 90))) for _ in range(n)]


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((key, t, t[:len(t) - half] + after[:half], after))
    return out


def test_same_as_all_terms(spark):
    rows = list(enumerate(texts(40))) + [(100, None), (101, ""), (102, " \n\t "), (103, "Éa 日本 x𝄞y"), (104, "one"), (105, "ONE"), (106, "a b\x1fc  d")]
    found = {r.doc_id: r for r in fp.with_edits(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for key, t, changed, after in edited(rows):
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        mine, theirs, following = brute(t), brute(changed), brute(after)
        assert (r.fingerprint, r.edited_fingerprint) == (mine, theirs)

        def same(x, y):
            return sum(x[i:i + 6] == y[i:i + 6] for i in range(0, len(x), 6)) / fp.SAMPLES

        assert (r.near_edited, r.near_next) == (same(mine, theirs), same(mine, following))


def test_shingles(spark):
    rows = list(enumerate(texts(12, 3))) + [(50, "a b")]
    found = {r.doc_id: r.fingerprint for r in fp.with_edits(frame(spark, rows), words=5, samples=16).collect()}
    assert found == {i: brute(t, 5, 16) for i, t in rows}


def test_collision_rate_is_the_similarity(spark):
    """Weights from 1 to 60, 1,500 functions: within four standard deviations."""
    rng = random.Random(9)
    pairs = []
    for _ in range(12):
        a = Counter({f"t{i}": rng.randrange(1, 60) for i in range(rng.randrange(3, 25))})
        b = Counter({t: max(1, n + rng.randrange(-20, 20)) for t, n in a.items() if rng.random() < 0.8}) + Counter({f"u{i}": rng.randrange(1, 30) for i in range(3)})
        pairs.append([" ".join(x.elements()) for x in (a, b)])
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    n = 1500
    codes = {r.doc_id: np.array(r.codes) for r in fp.fingerprints(frame(spark, rows), ["doc_id"], samples=n).collect()}
    for i, (a, b) in enumerate(pairs):
        want = jaccard(a, b)
        assert abs((codes[2 * i] == codes[2 * i + 1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / n) + 1e-9


def test_order_in_many_blocks(spark, monkeypatch):
    """The next document and the wrap do not depend on the blocks; null ids come last, rows equal in id and text follow each other."""
    monkeypatch.setattr(fp, "BLOCK_BYTES", 40)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)]
    found = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fp.with_edits(frame(spark, rows), samples=2).collect()}
    assert found == {k: (len(t), hashlib.sha256(c.encode()).hexdigest()) for k, t, c, _ in edited(rows)}
    odd = [(5, "same words here")] * 4 + [(None, f"null {i}") for i in range(6)] + [(-3, "low"), (1 << 62, "high")]
    found = fp.with_edits(frame(spark, odd), samples=4).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in odd)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    half = hashlib.sha256(b"same wor" + b"same wo").hexdigest()
    assert sum(r.edited_sha256 == half for r in by[5]) == 3 and by[1 << 62][0].edited_sha256 == hashlib.sha256(b"hisa").hexdigest()
    assert any(r.edited_sha256 == hashlib.sha256(b"nulhig").hexdigest() for r in by[None])


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(1, None), (2, "")]])
def test_small_tables(spark, rows):
    found = fp.with_edits(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.near_next == 1.0 for r in found)


def test_long_text(spark):
    t = " ".join(f"w{i % 50000}" for i in range(300_000))
    a, b = (r.fingerprint for r in fp.with_edits(frame(spark, [(1, t), (2, t)]), samples=4).collect())
    assert a == b and len(a) == 24


def test_one_exchange_of_texts_and_no_python(spark):
    plan = fp.with_edits(frame(spark, [(1, "a b"), (2, "c")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_possible_never_drops_the_least(spark):
    """The bound is below a for every term: weights of 1 and more, 20,000 draws."""
    d = spark.range(20_000).select(F.xxhash64("id").alias("t"), (F.col("id") % 7 * F.col("id") % 50 + 1).cast("double").alias("w"), (F.col("id") % 64).cast("int").alias("d"))
    a = F.shiftright(fp.sample(F.col("t"), F.col("w"), F.col("d")), fp.CODE_BITS) / F.lit(2.0 ** fp.FIXED)
    assert d.where(~fp.possible(F.col("t"), F.col("w"), a + 1e-9, F.col("d"))).count() == 0


def test_carried_columns_are_not_aggregated_with_every_term(spark):
    """Carried columns come back whole, nulls too, and the aggregation of terms holds nothing but the least sample."""
    rows = [(1, "a b a", 5, True, -(2 ** 63)), (2, None, None, False, 2 ** 63 - 1), (3, " ".join(f"w{i}" for i in range(300)), 7, None, 0)]
    docs = spark.createDataFrame(rows, "id long, text string, n int, flag boolean, sha long")
    got = fp.fingerprints(docs, ["id"], carried=["n", "flag", "sha"])
    assert [f.dataType.simpleString() for f in got.schema][1:4] == ["int", "boolean", "bigint"]
    assert sorted((r.id, r.n, r.flag, r.sha) for r in got.collect()) == [(i, n, f, s) for i, _, n, f, s in rows]
    plain = {r.id: r.codes for r in fp.fingerprints(docs, ["id"]).collect()}
    assert {r.id: r.codes for r in got.collect()} == plain and "".join(f"{c:06x}" for c in plain[3]) == brute(rows[2][1])
    assert "first(" not in got._jdf.queryExecution().optimizedPlan().toString()
