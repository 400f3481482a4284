"""Spark ML training and scoring, isolation forest, model metadata."""

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.angles import anomaly_sigmoid
from tickscope.functions.numbers import stable_round
from tickscope.functions.frames import one_row
from tickscope.operators.blocks import exact_percentile
from tickscope.operators.results import assert_no_leakage
from tickscope.plans.dataset import FEATURE_VERSION, FEATURES, canonical_features, population, schema_hash, supervised
from tickscope.plans.evaluation import best_threshold, binary_metrics, require_threshold, roc_auc
from tickscope.sources.ticks import require_coverage
from tickscope.sources.workdir import materialize

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"


def pipeline(cfg: AnalysisConfig = DEFAULT) -> Pipeline:
    """Assemble (a null feature is an error), scale, forest."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw", handleInvalid="error"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=cfg.n_trees, maxDepth=cfg.max_depth,
                               minInstancesPerNode=cfg.min_leaf, seed=cfg.seed),
    ])


def fit(train: DataFrame, cfg: AnalysisConfig = DEFAULT) -> PipelineModel:
    return pipeline(cfg).fit(canonical_features(train).withColumn("label", F.col("label").cast("double")))


def scale(features: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Standardised copies ``<feature>_z``; a constant feature becomes 0. Mean and deviation are those of ``fitted_on``, the training
    rows (default: the usable rows of the training split)."""
    stats = (supervised(features, "train") if fitted_on is None else fitted_on).agg(*[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES])
    d = features.withColumn("_s", one_row(stats))
    return d.select(*features.columns, *[
        F.coalesce(F.try_divide(F.col(f) - F.col(f"_s.{f}_m"), F.col(f"_s.{f}_s")), F.lit(0.0)).alias(f"{f}_z") for f in FEATURES])


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds ml_score, the probability of class 1 in percent; null where a feature is missing or not finite."""
    d = canonical_features(features)
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(f) < float("inf"), F.lit(False)) for f in FEATURES])
    # the assembler takes no null, so such rows pass with zeros and get their values and a null score afterwards
    filled = {f: F.when(F.col("_whole"), F.col(f)).otherwise(0.0) for f in FEATURES}
    out = model.transform(d.withColumn("_whole", whole).withColumns({f"_kept_{f}": F.col(f) for f in FEATURES}).withColumns(filled))
    probability = F.when(F.col("_whole"), vector_to_array("probability")[1] * 100.0)
    return out.select(*[F.col(f"_kept_{c}").alias(c) if c in FEATURES else F.col(c) for c in d.columns], probability.alias("ml_score"))


# --- isolation forest -------------------------------------------------------------------------------------------

def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Random isolation tree as node rows; ``path`` is the depth plus the expected rest, at leaves."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    n_ids = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        varying = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else np.array([], dtype=int)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + mean_path(len(rows))))
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] <= cut
        nodes.append((node, f, cut, n_ids, n_ids + 1, 0.0))
        todo += [(n_ids, rows[low], depth + 1), (n_ids + 1, rows[~low], depth + 1)]
        n_ids += 2
    return nodes


def tree_samples(rows: DataFrame, n_rows: int, key: str = "player_key", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """At most ``iforest_sample`` rows for each tree, drawn by hash.

    A row joins a tree's candidates with a probability that yields four times the sample, then the smallest
    hashes win; the limit is applied before the shuffle.
    """
    h = 1_000_000_007
    share = min(1.0, 4.0 * cfg.iforest_sample / max(n_rows, 1))

    def draw(t):
        return F.pmod(F.xxhash64(F.col(key), t, F.lit(cfg.seed)), F.lit(h))

    trees = F.filter(F.sequence(F.lit(0), F.lit(cfg.iforest_trees - 1)), lambda t: draw(t) <= int(share * h))
    d = rows.withColumn("tree", F.explode(trees)).withColumn("_d", draw(F.col("tree")))
    w = Window.partitionBy("tree").orderBy("_d", key)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cfg.iforest_sample).drop("_d", "_r")


def fit_isolation_forest(rows: DataFrame, columns: list[str], n_rows: int, key: str = "player_key",
                         cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Node table of all trees; each group is one tree's sample of at most 256 rows."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[columns].to_numpy(dtype=float)
        out = pd.DataFrame(grow_tree(x, cfg.seed * 100_003 + t), columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", t)
        return out

    sample = tree_samples(rows.select(key, *columns), n_rows, key, cfg)
    return sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def isolation_score(rows: DataFrame, nodes: DataFrame, columns: list[str], sample_size: int,
                    cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds ``raw_score`` = -2^(-mean path / c): near -1 is anomalous.

    The node table is bounded by trees x (2 x sample - 1) rows, so it is shipped to the tasks.
    """
    bound = cfg.iforest_trees * (2 * cfg.iforest_sample - 1)
    table = nodes.limit(bound + 1).toPandas()
    if len(table) > bound:
        raise ValueError("more nodes than the forest can have")
    trees = []
    for _, g in table.groupby("tree"):
        g = g.sort_values("node")
        trees.append(tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")))
    shipped = rows.sparkSession.sparkContext.broadcast(trees)
    c = mean_path(float(min(sample_size, cfg.iforest_sample)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for feature, cut, left, right, path in shipped.value:
                at = np.zeros(len(x), dtype=int)
                live = feature[at] >= 0
                while live.any():
                    i = np.flatnonzero(live)
                    n = at[i]
                    at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
                    live = feature[at] >= 0
                total += path[at]
            mean = total / max(len(shipped.value), 1)
            yield b.assign(raw_score=-np.exp2(-mean / c) if c > 0 else -0.5)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("raw_score", T.DoubleType())]))


def isolation_offset(scored_train: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """One row: the contamination percentile of the training scores."""
    return exact_percentile(scored_train.withColumn("_k", F.lit(1)), "raw_score", cfg.contamination, "offset", ("_k",),
                            widths=(1e-6, 1e-9))


def anomaly_scores(scored: DataFrame, offset: DataFrame) -> DataFrame:
    """decision = raw - offset (negative is an outlier) and its sigmoid."""
    return scored.withColumn("decision", F.col("raw_score") - one_row(offset.select("offset"))["offset"]).withColumn(
        "anomaly_score", stable_round(anomaly_sigmoid("decision"), 4)).drop("raw_score")


# --- metadata ---------------------------------------------------------------------------------------------------

def metadata_row(spark, threshold: float, threshold_suspect: float, **extra) -> DataFrame:
    values = {"feature_schema_version": FEATURE_VERSION, "feature_schema_hash": schema_hash(),
              "threshold": threshold, "threshold_high": threshold, "threshold_suspect": threshold_suspect, **extra}
    return spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in values.items()], F.array(*[F.lit(f) for f in FEATURES]).alias("features"),
        F.array(F.lit(0), F.lit(1)).alias("classes"))


def check_metadata(meta: DataFrame) -> DataFrame:
    """Adds ``problems``: what makes a model unusable, empty if nothing."""
    names = F.transform("features", lambda f: F.when(f == "aim_snap_max", F.lit("aim_p99")).otherwise(f))
    expected = F.array(*[F.lit(f) for f in FEATURES])
    high = F.coalesce("threshold_high", "threshold", F.lit(0.0))
    suspect = F.coalesce("threshold_suspect", F.lit(0.0))
    found = F.array(
        F.when(F.size("features") != len(FEATURES), F.lit("feature count")),
        F.when(names != expected, F.lit("feature schema")),
        F.when(F.col("classes") != F.array(F.lit(0), F.lit(1)), F.lit("classes")),
        F.when(~((suspect > 0) & (suspect < high) & (high <= 1)), F.lit("thresholds")))
    return meta.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def model_fingerprint(meta: DataFrame, content: str = "") -> DataFrame:
    parts = [F.col(c).cast("string") for c in ("dataset_name", "training_date", "threshold_high", "threshold_suspect")]
    return meta.withColumn("fingerprint", F.substring(F.sha2(
        F.concat_ws("|", *parts, F.lit(schema_hash()), F.lit(content)), 256), 1, 16))


def fit_outliers(train: DataFrame, cfg: AnalysisConfig = DEFAULT) -> dict:
    """Isolation forest on the clean rows of the training split: nodes, offset, number of rows, and the scaling that goes with them."""
    cols = [f"{c}_z" for c in FEATURES]
    clean = scale(train, train).where("label = 0").select("player_key", *cols)
    n = clean.count()
    nodes = materialize(fit_isolation_forest(clean, cols, n, cfg=cfg), "nodes")
    offset = isolation_offset(isolation_score(clean, nodes, cols, n, cfg), cfg).select("offset")
    stats = train.agg(*[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES])
    return {"nodes": nodes, "offset": materialize(offset, "offset"), "stats": materialize(stats, "scaling"), "rows": n}


def score_outliers(outliers: dict, features: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds ``decision`` and ``anomaly_score``; null where a feature is missing or not finite."""
    d = features.withColumn("_s", one_row(outliers["stats"]))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.abs(f) < float("inf"), F.lit(False)) for f in FEATURES])
    z = d.select(*features.columns, whole.alias("_whole"), *[F.when(whole, F.coalesce(
        F.try_divide(F.col(f) - F.col(f"_s.{f}_m"), F.col(f"_s.{f}_s")), F.lit(0.0))).otherwise(0.0).alias(f"{f}_z") for f in FEATURES])
    raw = isolation_score(z, outliers["nodes"], [f"{f}_z" for f in FEATURES], outliers["rows"], cfg)
    out = anomaly_scores(raw, outliers["offset"])
    return out.select(*features.columns, *[F.when(F.col("_whole"), F.col(c)).alias(c) for c in ("decision", "anomaly_score")])


def train(features: DataFrame, cfg: AnalysisConfig = DEFAULT, status: DataFrame | None = None, path: str | None = None) -> dict:
    """Fit on train, choose the threshold on validation, measure on test. Features are read several times:
    give a written table.

    Fails before any fit if too many matches of ``status`` were rejected or a match is in two splits. ``path`` stores the bundle.
    """
    if status is not None:
        require_coverage(status, cfg.max_failure_rate)
    assert_no_leakage(features, ("match_id",))
    tr, va, te = (supervised(features, s) for s in ("train", "validation", "test"))
    model, outliers = fit(tr, cfg), fit_outliers(tr, cfg)

    def scored(d):
        return score(model, d).withColumn("score", F.col("ml_score") / 100.0)

    chosen = best_threshold(scored(va)).first()
    thr = require_threshold(chosen)
    test = scored(te)
    counts = {f"{r['split']}_{r['label']}": r["count"] for r in population(supervised(features)).collect()}
    measured = binary_metrics(test, thr).first().asDict()
    auc = roc_auc(test).first()["roc_auc"]
    meta = metadata_row(features.sparkSession, thr, float(chosen["threshold_suspect"]), seed=cfg.seed, outlier_rows=outliers["rows"],
                        counts=json.dumps(counts, sort_keys=True), test_metrics=json.dumps({**measured, "roc_auc": auc}, sort_keys=True))
    bundle = {"model": model, "outliers": outliers, "meta": meta, "threshold": thr, "validation": chosen.asDict(), "counts": counts,
              "test": measured, "test_auc": auc}
    if path:
        save_bundle(bundle, path)
    return bundle


def save_bundle(bundle: dict, path: str) -> None:
    bundle["model"].write().save(f"{path}/forest")
    for name in ("nodes", "offset", "stats"):
        bundle["outliers"][name].write.parquet(f"{path}/{name}")
    bundle["meta"].write.json(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> dict:
    """Model, outlier forest and metadata again; metadata that does not fit this schema is an error."""
    meta = spark.read.json(f"{path}/meta")
    for c in ("threshold", "threshold_high", "threshold_suspect"):
        meta = meta.withColumn(c, F.col(c).cast("double"))
    meta = meta.withColumn("classes", F.col("classes").cast("array<int>"))
    problems = check_metadata(meta).first()["problems"]
    if problems:
        raise ValueError(f"unusable model: {', '.join(problems)}")
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "offset", "stats")}
    return {"model": PipelineModel.load(f"{path}/forest"), "outliers": parts | {"rows": meta.first()["outlier_rows"]}, "meta": meta}


def score_players(bundle: dict, players: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds ``ml_score`` and ``anomaly_score`` to rows with the fifteen features."""
    return score_outliers(bundle["outliers"], score(bundle["model"], players), cfg).drop("decision")
