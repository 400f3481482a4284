"""Splits, labels, metrics, thresholds, models."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import one
from pyspark.sql import functions as F

from tickscope.config import DEFAULT
from tickscope.operators import results
from tickscope.plans import dataset, evaluation, training


def matches(spark, n_with, n_without):
    rows = [(f"w{i}", dataset.WITH) for i in range(n_with)] + [(f"n{i}", dataset.WITHOUT) for i in range(n_without)]
    return spark.createDataFrame(rows, "match_id string, label string")


@pytest.mark.parametrize("a,b", [(1, 1), (2, 3), (6, 6), (40, 60)])
def test_split(spark, a, b):
    m = matches(spark, a, b)
    d = dataset.split_matches(m).toPandas()
    assert sorted(d.match_id) == sorted(m.toPandas().match_id)  # every match once: splits are disjoint
    n = d.split.value_counts().to_dict()
    if a + b < 3:
        assert n == {"train": a + b}
    elif (a, b) == (40, 60):
        assert n == {"train": 70, "validation": 15, "test": 15}
        assert (d[d.label == dataset.WITH].split.value_counts().to_dict()) == {"train": 28, "validation": 6, "test": 6}
    else:
        assert set(n) <= {"train", "validation", "test"} and n["train"] >= n.get("test", 0)
    again = dataset.split_matches(m.repartition(3)).toPandas()
    assert d.sort_values("match_id").reset_index(drop=True).equals(again.sort_values("match_id").reset_index(drop=True))


def test_balanced_sample(spark):
    n = dataset.balanced_sample(matches(spark, 3, 20), 10).groupBy("label").count().toPandas().set_index("label")["count"].to_dict()
    assert n == {dataset.WITH: 3, dataset.WITHOUT: 7}
    for asked in (23, 40):
        assert dataset.balanced_sample(matches(spark, 3, 20), asked).count() == 23


def test_unknown_is_not_clean(spark):
    man = spark.createDataFrame([("w", dataset.WITH, "train"), ("n", dataset.WITHOUT, "test"), ("o", "other", "test")],
                                "match_id string, match_category string, split string")
    p = spark.createDataFrame([("w", "c"), ("w", "x"), ("n", "c"), ("o", "x")], "match_id string, steamid string")
    ch = spark.createDataFrame([("w", "c"), ("w", "c")], "match_id string, steamid string")
    got = {r.player_key: (r.label, r.label_text, r.usable_for_training) for r in dataset.label_players(p, man, ch).collect()}
    assert got == {"w_c": (1, "verified_cheater", True), "w_x": (-1, "unknown", False), "n_c": (0, "probable_non_cheater", True),
                   "o_x": (-1, "unknown", False)}


def test_leakage(spark):
    d = spark.createDataFrame([("m", "a", "train"), ("m", "b", "test"), ("m", "a", "train")], "match_id string, steamid string, split string")
    results.assert_no_leakage(d)
    with pytest.raises(RuntimeError):
        results.assert_no_leakage(d.union(spark.createDataFrame([("m", "a", "test")], d.schema)))


def test_metrics_against_counts(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 500), "score": rng.integers(0, 40, 500) / 40})
    r = one(evaluation.binary_metrics(spark.createDataFrame(pdf), 0.5))
    hit = pdf.score >= 0.5
    assert (r["tp"], r["fp"]) == ((hit & (pdf.label == 1)).sum(), (hit & (pdf.label == 0)).sum())
    pos, neg = pdf[pdf.label == 1].score.to_numpy(), pdf[pdf.label == 0].score.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert one(evaluation.roc_auc(spark.createDataFrame(pdf)))["roc_auc"] == pytest.approx(want, abs=1e-4)
    sweep = {round(x.threshold, 2): x for x in evaluation.threshold_sweep(spark.createDataFrame(pdf)).collect()}
    assert len(sweep) == 19 and sweep[0.5].tp == r["tp"] and sweep[0.5].fn == r["fn"]


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_threshold_choice(spark):
    d = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.2)])
    b = evaluation.best_threshold(d).first()
    assert b.threshold == 0.8 and b.threshold_suspect == 0.4 and evaluation.require_threshold(b) == 0.8
    single = evaluation.best_threshold(scored(spark, [(1, 0.9), (1, 0.1)])).first()
    assert single.threshold == 0.5 and single.single_class
    with pytest.raises(RuntimeError):
        evaluation.require_threshold(evaluation.best_threshold(d.where("false")).first())
    with pytest.raises(ValueError):
        evaluation.require_threshold(evaluation.best_threshold(scored(spark, [(1, 0.0), (0, 0.5)])).first())
    assert one(evaluation.roc_auc(scored(spark, [(1, 0.9)])))["roc_auc"] is None


@pytest.fixture(scope="module")
def feature_table(spark):
    rng = np.random.default_rng(5)
    n = 240
    label = rng.integers(0, 2, n)
    pdf = pd.DataFrame({f: rng.normal(size=n) + 3.0 * label * (i < 4) for i, f in enumerate(dataset.FEATURES)})
    pdf["label"], pdf["player_key"], pdf["usable_for_training"] = label, [f"k{i}" for i in range(n)], True
    pdf["split"] = np.where(np.arange(n) % 10 < 6, "train", np.where(np.arange(n) % 10 < 8, "validation", "test"))
    pdf["match_id"] = [f"m{i % 10}" for i in range(n)]
    return spark.createDataFrame(pdf).cache()


def test_training(spark, feature_table, tmp_path):
    cfg = replace(DEFAULT, n_trees=20, iforest_trees=20)
    out = training.train(feature_table, cfg, path=str(tmp_path / "bundle"))
    again = training.load_bundle(spark, str(tmp_path / "bundle"))
    a, b = (training.score_players(x, feature_table, cfg).orderBy("player_key").select("ml_score", "anomaly_score").collect() for x in (out, again))
    assert a == b and all(0 <= r.ml_score <= 100 for r in a)
    assert out["counts"]["train_0"] + out["counts"]["train_1"] == 144
    broken = feature_table.withColumn("aim_p99", F.when(F.col("player_key") != "k3", F.col("aim_p99")))
    odd = {r.player_key: r for r in training.score_players(again, broken, cfg).collect()}
    assert odd["k3"].ml_score is None and odd["k3"].anomaly_score is None and odd["k4"].ml_score is not None
    with pytest.raises(RuntimeError):
        training.train(feature_table.withColumn("match_id", F.lit("one")), cfg)
    rejected = spark.createDataFrame([("a", "rejected")], "match_id string, status string")
    with pytest.raises(RuntimeError):
        training.train(feature_table, cfg, status=rejected)
    assert out["test"]["f1"] > 0.8 and out["test_auc"] > 0.9
    meta = training.check_metadata(out["meta"]).first()
    assert meta.problems == [] and 0 < meta.threshold_suspect < meta.threshold_high <= 1


def test_scaling_knows_the_training_rows_only(spark, feature_table):
    far = feature_table.withColumn("aim_p99", F.when(F.col("split") == "train", F.col("aim_p99")).otherwise(1e6))
    z = training.scale(far).where("split = 'train'").agg(F.avg("aim_p99_z"), F.stddev_pop("aim_p99_z")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9


def test_missing_feature_is_an_error(spark, feature_table):
    broken = feature_table.withColumn("aim_p99", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="null while assembling|Encountered null|FAILED_EXECUTE_UDF|fit"):
        training.fit(dataset.supervised(broken, "train"), replace(DEFAULT, n_trees=2))


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 2))
    x[:10] += 8.0
    pdf = pd.DataFrame({"player_key": [f"k{i}" for i in range(1500)], "a": x[:, 0], "b": x[:, 1]})
    d = spark.createDataFrame(pdf).repartition(4)
    cfg = replace(DEFAULT, iforest_trees=50)
    nodes = training.fit_isolation_forest(d, ["a", "b"], 1500, cfg=cfg).cache()
    sizes = training.tree_samples(d.select("player_key", "a", "b"), 1500, cfg=cfg).groupBy("tree").count().toPandas()
    assert len(sizes) == 50 and (sizes["count"] == 256).all()
    s = training.isolation_score(d, nodes, ["a", "b"], 1500, cfg)
    off = training.isolation_offset(s, cfg)
    got = training.anomaly_scores(s, off).toPandas().set_index("player_key")["decision"].sort_values()
    assert set(got.index[:10]) == {f"k{i}" for i in range(10)}
    assert (got < 0).mean() == pytest.approx(0.04, abs=0.005)


def test_walk_through_saved_trees(spark):
    """Spark's own probability of every row, and the importances, from the saved nodes alone; a forest without chance by hand."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tickscope.plans import forests
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", *map(float, np.round(rng.normal(size=4), 2)), int(rng.random() < 0.4)) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, a double, b double, c double, d double, label int")
    v = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="scaled").transform(d)
    model = RandomForestClassifier(featuresCol="scaled", numTrees=17, maxDepth=5, seed=4).fit(v)
    nodes = forests.saved_nodes(spark, model)
    want = {r.k: r.p for r in model.transform(v).select("k", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.k: r.value for r in forests.walk(v, nodes, vector_to_array("scaled"), "k", 5).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12 and len(set(got.values())) > 50
    weights = {r.feature: r.importance for r in forests.importances(nodes).collect()}
    assert [weights.get(i, 0.0) for i in range(4)] == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-9)

    plain = forests.midpoint_forest(d, ["a", "b", "c", "d"])
    x, y = np.array([r[1:5] for r in rows]), np.array([r[5] for r in rows])
    cut = (x.min(axis=0) + x.max(axis=0)) / 2
    leaf = [(x[:, i] > cut[i]) * 2 + (x[:, i + 1] > cut[i + 1]) for i in (0, 2)]
    by_hand = np.mean([[y[leaf[t] == leaf[t][r]].mean() for r in range(300)] for t in range(2)], axis=0)
    got = {r.k: r.value for r in forests.walk(d, plain, F.array("a", "b", "c", "d"), "k", 2).collect()}
    assert [got[f"k{i}"] for i in range(300)] == pytest.approx(by_hand.tolist())
