"""Whitening of embeddings: distributed exact sums and covariance, eigenvectors in float32 refined in higher precision.

An entry c becomes the whole number x = floor(1024 c) + 100000. Tasks add up x exactly, then the products of the centred (n x - S) / n; a width of d
gives d (d + 1) / 2 numbers to the driver, whatever the rows. There numpy finds eigenvectors in float32, and iterations of Ogita and Aishima, a few
matrix products each, correct them: with R = I - X'X and S = X'AX the eigenvalues are S_ii / (1 - R_ii), and X becomes X + XE with
E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where two eigenvalues are too close to be told apart. The vectors of such a cluster span the right
space but are not the right ones in it; the small problem X_J'(A - mI)X_J, shifted by the cluster's mean, turns them, and the next iteration goes on.

Defined cases: rows whose vector is null, empty or holds a null, non-finite or huge entry (2^43 or more) are left out, and so are vectors of another
width than the most frequent one (the greater of equally frequent ones). A component without variance (below the rounding of the trace) has null
``whitened``. ``deviation`` is null beyond a long. Rows with equal or null ids are rows of their own; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.sources.workdir import materialize

SCALE, SHIFT = 1024.0, 100_000
#: Entries below it times SCALE are whole numbers that a double holds.
HUGE = 2.0 ** 43
SAFE = 1 << 62
#: Widest matrix that is refined in 80-bit numbers, whose products are slow; wider ones are refined in 64 bits.
EXTENDED_WIDTH = 256
ITERATIONS = 12


def valid(vec: Column) -> Column:
    """A vector with entries that are all there, finite and not huge; a NaN is no number below the bound."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & (F.abs(c) < HUGE)), F.lit(False))


def whole_numbers(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(-1, width) * SCALE).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def fit_list(rows: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """Valid rows of the most frequent width, and that width (0 without rows)."""
    good = rows.where(valid(F.col(vec_col)))
    first = good.groupBy(F.size(vec_col).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return (good.where(F.size(vec_col) == first["width"]), first["width"]) if first else (good, 0)


def exact_sums(rows: DataFrame, vec_col: str, width: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            x = whole_numbers(b, 0, width)
            if len(x) * int(np.abs(x).max(initial=0)) >= SAFE:
                x = x.astype(object)
            n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(axis=0))]
        kind = pa.decimal128(38, 0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, width), pa.int32()), "total": pa.array([n, *total]).cast(kind)
                                              if max(map(abs, total)) < SAFE else pa.array([_decimal(t) for t in [n, *total]], kind)})

    found = rows.select(vec_col).mapInArrow(partial, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    at = {r["dim"]: int(r["total"]) for r in found.collect()}  # width + 1
    return at.get(-1, 0), [at.get(i, 0) for i in range(width)]


def _decimal(t: int):
    from decimal import Decimal

    return Decimal(t)


def covariance(rows: DataFrame, vec_col: str, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x, centred before multiplying: one row per task and place of the upper triangle, added up by Spark."""
    width = len(sums)
    i, j = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((width, width)), False
        for b in batches:
            z = centred(whole_numbers(b, 0, width), n, sums).astype(np.float64) / n
            total, any_rows = total + z.T @ z, True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    found = rows.select(vec_col).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[found["i"], found["j"]] = found["v"] / n
    return out + np.triu(out, 1).T


def clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues that are linked by gaps of at most ``close``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of the symmetric ``a`` from approximate ones ``x``, in the precision of ``a``."""
    one, eps = np.eye(len(a), dtype=a.dtype), np.finfo(a.dtype).eps
    size = np.linalg.norm(a.astype(np.float64), 2)
    last = np.inf
    for _ in range(iterations):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        close = float(2 * (np.linalg.norm((s - np.diag(np.diag(s))).astype(np.float64), 2) + size * np.linalg.norm(r.astype(np.float64), 2)))
        gap, groups = values[None, :] - values[:, None], clusters(values, close)
        apart = np.abs(gap) > close
        for g in groups:
            apart[np.ix_(g, g)] = False
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for g in groups:
            part, shift = x[:, g], values[g].mean()
            inner = part.T @ (a @ part - shift * part)
            top = np.abs(inner).max()
            if top > 0:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * top)).astype(np.float64))[1]
                x[:, g] = part @ turn.astype(a.dtype)
        moved = float(np.abs(e).max())
        if moved <= 4 * eps or (not groups and last <= moved < 1e-6):
            break
        last = moved
    for _ in range(2):  # what rounding has left of R, for vectors that only rounding tells apart
        x = x + x @ (one - x.T @ x) / 2
    return (x * (a @ x)).sum(axis=0), x


def eigen(v: np.ndarray, extended_width: int = EXTENDED_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest down and their vectors as columns, in double precision; the greatest entry of a vector is positive."""
    scale = np.abs(v).max() or 1.0
    start = np.linalg.eigh((v / scale).astype(np.float32))[1]
    kind = np.longdouble if len(v) <= extended_width else np.float64
    values, x = refine(v.astype(kind) / kind(scale), start.astype(kind))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return (values[order] * kind(scale)).astype(np.float64), x.astype(np.float64)


def project(rows: DataFrame, id_col: str, vec_col: str, n: int, sums: list[int], axes: np.ndarray, spread: np.ndarray) -> DataFrame:
    """(id, deviation, w): w holds (x - S / n) on each axis over its spread, null where the spread is 0."""
    width, defined = len(sums), spread > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = centred(whole_numbers(b, 1, width), n, sums)
            z = d.astype(np.float64)
            if len(z) and (z * z).sum(axis=1).max() >= SAFE:
                whole = [t if t < 1 << 63 else None for t in (sum(int(c) ** 2 for c in r) for r in d)]
            else:
                whole = (d * d).sum(axis=1).astype(np.int64)
            w = np.where(defined, (z / n) @ axes / np.where(defined, spread, 1), np.nan)
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.int64()), lists], ["_id", "deviation", "w"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")).mapInArrow(run, f"_id {kind}, deviation long, w array<double>")


def identity_error(w: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` (its defined components) minus the identity."""
    x = [F.get("w", F.lit(i)) for i in range(k)]
    errors = [F.abs(F.covar_pop(x[i], x[j]) - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i + 1)]
    return w.agg(F.array_max(F.array(*errors)).alias("e")).first()["e"] or 0.0


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """Per valid row and component up to ``components``: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    good, width = fit_list(rows, vec_col)
    kind = rows.schema[id_col].dataType.simpleString()
    if not width:
        return rows.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums = exact_sums(good, vec_col, width)
    v = covariance(good, vec_col, n, sums)
    values, axes = eigen(v)
    k, trace = min(components, width), float(np.trace(v))
    values, axes = values[:k], axes[:, :k]
    spread = np.where(values > width * np.finfo(float).eps * trace, np.sqrt(np.maximum(values, 0)), 0.0)
    w = materialize(project(good, id_col, vec_col, n, sums, axes, spread), "whitened")
    error = identity_error(w, k)
    explained = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values])
    return w.select("_id", "deviation", F.posexplode("w").alias("_i", "whitened")).select(
        F.col("_id").alias(id_col), (F.col("_i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"))
