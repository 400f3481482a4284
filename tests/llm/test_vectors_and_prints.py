"""Similarity operators against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickscope.llm import embedding_dedup, simhash
from tickscope.llm.components import components
from tickscope.llm.forest import Union

EMB = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, fp string, component_id string"


def smallest(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links + [(None, 3), (4, 4)], "a long, b long")).collect()}
    want = smallest({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_in_a_task():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 500, (2, 400))
    u = Union(500)
    u.add(i[:200], j[:200])
    u.add(i[200:], j[200:])
    want = smallest(range(500), list(zip(i.tolist(), j.tolist())))
    assert u.label.tolist() == [want[k] for k in range(500)]


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [c * rng.uniform(0.1, 9) + rng.standard_normal(24) * s for c in centres for s in (0, 0.1, 0.3, 0.4, 0.45, 0.5) for _ in range(4)]
    rows += [rows[0]] * 30 + [-rows[0], rows[1] * 1000]
    rows = [[float(x) for x in r] for r in rows]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, rows[0][:8], rows[0][:8]]
    return list(enumerate(rows + odd))


def brute_vectors(rows, cosine):
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    label = smallest([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, _ in links:
        n[a] += 1
    return {i: (n[i], label[i], label[i] == i) for i, _ in rows}


@pytest.mark.parametrize("tile,width,axes", [(16384, 16, 2), (20, 8, 1), (50, 5, 3)])
def test_vectors_like_all_pairs(spark, tile, width, axes):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    got = embedding_dedup.near_vectors(df, tile=tile, block_width=width, grid_axes=axes).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows, 0.9)
    assert len(got) == len(rows)


def test_vector_cases(spark):
    empty = spark.createDataFrame([], EMB)
    assert embedding_dedup.near_vectors(empty).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], EMB).withColumn("n_links", empty.sparkSession.range(1).count() * __import__("pyspark").sql.functions.lit("x"))
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)], key=str)


def brute_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


TEXTS = [None, "", " \n\t ", "one", "One two", "one TWO", "a b c d", "É é x y z", "x " * 5000, "w" * 20000, "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_like_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(64, k, replace=False)) - (0)) for b in base for k in (0, 1, 2, 3, 4) for _ in range(3)]
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in (n % (1 << 64) for n in near)} | {0, 1, 3, 7, -1})
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, tile).collect()]
    want = smallest(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2])
    assert smallest(fps, links) == want


def test_tile_pairs_of_equal_counts_are_spread(spark):
    rng = np.random.default_rng(6)
    halves = np.array([x for x in range(1 << 16) if x.bit_count() == 8], dtype=np.uint64)
    fps = np.unique(sum(rng.choice(halves, 20_000) << np.uint64(16 * k) for k in range(4)).view(np.int64))
    pairs = simhash.tile_pairs(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 2, 256)
    n = -(-len(fps) // 256)
    each = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(each) == n * (n + 1) // 2
    assert max(each) < 0.5 * sum(each)
    assert pairs.where("same").count() == n


def test_near_duplicates_like_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS, long, long + " tail", long.upper(), "w0 " + long, *["same text of some words here"] * 40]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = smallest(fps, [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, "a", "", "")], DOCS)).collect()] == [None]
