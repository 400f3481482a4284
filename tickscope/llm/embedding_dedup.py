"""Near-duplicate vectors: pigeonhole join over subspaces, every candidate verified in double precision.

Unit vectors x, y with cosine >= t have |x - y|^2 <= 2 - 2t = D. After one random rotation the coordinates are cut into
blocks; block b with k of d coordinates gets the share D k/d. If every block of a pair exceeded its share, the sum would exceed
D, so a linked pair is within its share in some block. Each block is range-joined on a grid over its first coordinates
whose cells are twice as wide as the block's radius: a vector is at home in one cell and visits each later cell that its radius
touches. A cell's rows are cut into tiles of bounded size and only pairs of tiles meet, so a cell with most of all vectors
is many tasks. A pair belongs to the first block that admits it, so nothing is counted twice and no pair leaves a
task: tasks return link counts per vector and a spanning forest.

Defined cases: null, empty or zero vectors and vectors with null or non-finite components link with nothing, nor do vectors of
different length. Equal vectors are one row with a count. A row without an id has no links and is not kept.
Repeated ids count as separate vectors of one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.components import components
from tickscope.llm.forest import Union
from tickscope.sources.workdir import materialize

#: Errors of matrix products in single precision stay below this; pairs nearer to a limit are decided coordinate by coordinate.
SLACK = 1e-4
#: Added to each share: more than what rounding the rotated coordinates to single precision can change.
ROUNDING = 1e-6


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int, distance: float) -> list[tuple[slice, float]]:
    """Coordinate range and squared-distance share of each block."""
    return [(slice(i, min(i + width, dim)), distance * (min(i + width, dim) - i) / dim) for i in range(0, dim, width)]


def unit_rows(raw: pd.Series, kind: str) -> np.ndarray:
    m = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _places(width: int, axes: int, distance: float, seed: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                raw = part["vec"].map(lambda v: np.asarray(v, kind).tobytes())
                turned = (unit_rows(raw, kind) @ rotation(dim, seed)).astype("<f4")
                found: list[list[tuple]] = [[] for _ in range(len(part))]
                for b, (cols, share) in enumerate(blocks_of(dim, width, distance)):
                    z = turned[:, cols][:, :axes].astype(np.float64)
                    r = np.sqrt(share + SLACK)
                    low, high, home = (np.floor(v / (2 * r)).astype(int) for v in (z - r, z + r, z))
                    for i in range(len(z)):
                        cells = [()]
                        for a in range(z.shape[1]):
                            cells = [(*c, x) for c in cells for x in range(low[i, a], high[i, a] + 1)]
                        own = tuple(home[i])
                        found[i] += [(b, ",".join(map(str, c)), c == own) for c in cells if c >= own]
                yield part.assign(dim=dim, vec=raw, turned=[t.tobytes() for t in turned], places=found)

    return run


def _near_in_tiles(width: int, cosine: float, kind: str, rows_at_once: int = 1024):
    distance = 2 - 2 * cosine

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0])
        cuts = blocks_of(dim, width, distance)
        unit = unit_rows(pdf["vec"], kind)
        turned = np.stack([np.frombuffer(x, "<f4") for x in pdf["turned"]]).astype(np.float64)
        left = np.flatnonzero(pdf["side"].to_numpy() == 0)
        same = int(pdf["p"].iloc[0]) == int(pdf["q"].iloc[0])
        right = left if same else np.flatnonzero(pdf["side"].to_numpy() == 1)
        times = pdf["times"].to_numpy()
        links = np.zeros(len(pdf), dtype=np.int64)
        forest = Union(len(pdf))

        def augmented(rows: np.ndarray, b: int, second: bool) -> np.ndarray:
            z = turned[np.ix_(rows, range(*cuts[b][0].indices(dim)))].astype(np.float32)
            half = -(z * z).sum(axis=1, keepdims=True) / 2
            one = np.ones_like(half)
            return np.hstack([z, one, half] if second else [z, half, one])

        def within(i: np.ndarray, j: np.ndarray, b: int) -> np.ndarray:
            """Decided in double precision in a fixed order, so that every task decides a pair alike."""
            total = np.zeros(len(i))
            for c in range(*cuts[b][0].indices(dim)):
                d = turned[i, c] - turned[j, c]
                total += d * d
            return total <= cuts[b][1] + ROUNDING

        def admitted(rows: np.ndarray, cols: np.ndarray, b: int) -> np.ndarray:
            """Which pairs rows x cols are within the share of block b."""
            score = augmented(rows, b, False) @ augmented(cols, b, True).T
            edge = np.float32(-cuts[b][1] / 2)
            got = score > edge
            i, j = np.nonzero(np.abs(score - edge) < SLACK / 2)
            if len(i):
                got[i, j] = within(rows[i], cols[j], b)
            return got

        def hits(rows: np.ndarray, cols: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
            score = augmented(rows, b, False) @ augmented(cols, b, True).T
            return np.nonzero(score > np.float32(-(cuts[b][1] + SLACK) / 2))

        for at in range(0, len(left), rows_at_once):
            rows = left[at:at + rows_at_once]
            for to in range(0, len(right), rows_at_once):
                if same and to < at:
                    continue
                cols = right[to:to + rows_at_once]
                i, j = hits(rows, cols, block)
                if not len(i):
                    continue
                if len(i) * 20 < len(rows) * len(cols):
                    i, j = rows[i], cols[j]
                    ok = within(i, j, block) & ((j > i) if same else True)
                    for b in range(block):
                        i, j, ok = i[ok], j[ok], np.ones(int(ok.sum()), bool)
                        ok &= ~within(i, j, b)
                    i, j = i[ok], j[ok]
                    near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                    i, j = i[near], j[near]
                else:  # a dense patch: whole matrices cost less than gathered pairs
                    r, c = rows[np.unique(i)], cols[np.unique(j)]
                    ok = admitted(r, c, block)
                    if same:
                        ok &= c[None, :] > r[:, None]
                    for b in range(block):
                        if ok.any():
                            ok &= ~admitted(r, c, b)
                    if not ok.any():
                        continue
                    ok &= unit[r] @ unit[c].T >= cosine
                    i, j = np.nonzero(ok)
                    i, j = r[i], c[j]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                forest.add(i, j)
        ids = pdf["rep"].to_numpy()
        some = np.flatnonzero(links)
        i, j = forest.links()
        return pd.DataFrame({"link": np.repeat([False, True], [len(some), len(i)]), "a": np.concatenate([ids[some], ids[i]]),
                             "b": np.concatenate([links[some], ids[j]])})

    return run


def valid(vec: Column) -> Column:
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, block_width: int = 16,
                 grid_axes: int = 2, tile: int = 16384, seed: int = 17) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept`` at cosine similarity ``cosine`` or more (0 < cosine < 1).

    ``tile`` bounds the rows that one side of a task holds.
    """
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    used = (own.where(F.col("vec_id").isNotNull() & valid(F.col("vec")))
            .select("vec_id", F.transform("vec", lambda v: v.cast("double") + F.lit(0.0)).alias("vec")))
    kind = "<f4" if dict(df.dtypes)[vec_col] == "array<float>" else "<f8"
    groups = materialize(used.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "vectors")

    placed = materialize(groups.repartition("rep").mapInPandas(
        _places(block_width, grid_axes, 2 - 2 * cosine, seed, kind),
        "vec binary, rep long, times long, dim int, turned binary, places array<struct<block:int, cell:string, home:boolean>>"),
        "places")
    each = placed.select("rep", "times", "dim", "vec", "turned", F.inline("places"))
    # a grid over unit vectors has few cells: (1/r + 2)^axes per block
    sizes = each.groupBy("dim", "block", "cell").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("long")) / tile)).cast("int").alias("homes"),
        F.ceil(F.sum((~F.col("home")).cast("long")) / tile).cast("int").alias("guests"))
    dealt = each.join(sizes, ["dim", "block", "cell"]).withColumn("salt", F.xxhash64("rep", F.lit(seed)))
    mine = F.pmod("salt", F.col("homes")).cast("int")
    theirs = F.pmod("salt", F.col("guests")).cast("int") + F.col("homes")
    with_homes = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(
        F.least(o, mine).alias("p"), F.greatest(o, mine).alias("q"), (o < mine).cast("int").alias("side")))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda o: F.struct(
        (o + F.col("homes")).alias("p"), mine.alias("q"), F.lit(1).alias("side"))))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(
        theirs.alias("p"), o.alias("q"), F.lit(0).alias("side")))
    goes = F.when(F.col("home"), F.concat(with_homes, F.coalesce(with_guests, F.slice(with_homes, 1, 0)))).otherwise(as_guest)
    tiles = dealt.select("rep", "times", "dim", "vec", "turned", "block", "cell", F.inline(goes))
    found = materialize(tiles.groupBy("dim", "block", "cell", "p", "q").applyInPandas(
        _near_in_tiles(block_width, cosine, kind), "link boolean, a long, b long"), "near")
    member = components(found.where("link").select("a", "b"))
    counts = found.where("not link").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    answer = (groups.select("vec", "rep", "times").join(counts, "rep", "left").join(
        member.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("vec", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")))
    rows = own.select("vec_id", F.when(F.col("vec_id").isNotNull() & valid(F.col("vec")), F.transform(
        "vec", lambda v: v.cast("double") + F.lit(0.0))).alias("vec"))
    return rows.join(answer, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
