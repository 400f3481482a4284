"""Queries of the dataset plan, evaluation and models."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickscope.config import DEFAULT as CFG
from tickscope.functions.frames import one_row
from tickscope.functions.numbers import stable_round
from tickscope.operators import results
from tickscope.operators.blocks import PLAYER
from tickscope.plans import dataset, evaluation, forests, training
from tickscope.plans import inputs as I
from tickscope.plans.registry import query
from tickscope.sources import files
from tickscope.sources import ticks as readers
from tickscope.sources.workdir import materialize


def match_no():
    """Number of the match; a function because a column needs a running session."""
    return F.expr("cast(substring(match_id, 2) as bigint)")


K_SQL = "CAST(substr(match_id, 2) AS BIGINT)"


def user_no():
    return F.expr("cast(substring(name, 2) as bigint)")


CLASS_SQL = f"CASE WHEN {K_SQL} % 2 = 0 THEN 'with_cheater_present' ELSE 'no_cheater_present' END"


def class_of_match():
    return F.when(match_no() % 2 == 0, dataset.WITH).otherwise(dataset.WITHOUT)


def pairs(spark, sf):
    """One tick file and one metadata file per match of the telemetry view."""
    folder = F.concat(F.lit("/data/"), class_of_match(), F.lit("/"), F.col("match_id"))
    listing = I.ticks(spark, sf).select("match_id").distinct().select(folder.alias("f")).select(
        F.explode(F.array(F.concat("f", F.lit(".parquet")), F.concat("f", F.lit(".json")))).alias("path"))
    return files.discover_pairs(listing)


def verified(spark, sf):
    """Every seventh user of a match with cheaters."""
    return I.ticks(spark, sf).where(user_no() % 7 == 0).where(match_no() % 2 == 0).select("match_id", "steamid").distinct()


def cheaters(spark, sf):
    """The same under manifest ids."""
    return verified(spark, sf).select(F.concat(F.lit(dataset.WITH + "_"), F.col("match_id")).alias("match_id"), "steamid")


def manifest(spark, sf):
    return I.stored(spark, sf, "manifest", lambda: _manifest(spark, sf))


def _manifest(spark, sf):
    v = verified(spark, sf).select(F.lit(dataset.WITH).alias("match_category"), F.col("match_id").alias("base"), "steamid")
    return dataset.build_manifest(pairs(spark, sf), v)


def manifest_with_split(spark, sf):
    return dataset.split_matches(manifest(spark, sf))


MANIFEST_SQL = I.BASE_SQL + f""",
ver AS (SELECT DISTINCT match_id, steamid FROM ticks WHERE CAST(substr(name, 2) AS BIGINT) % 7 = 0 AND {K_SQL} % 2 = 0),
mm AS (SELECT DISTINCT match_id AS base, {CLASS_SQL} AS label FROM ticks),
vv AS (SELECT match_id AS base, string_agg(steamid, ',' ORDER BY steamid) AS cheaters, count(*) AS n FROM ver GROUP BY 1),
man AS (
  SELECT label || '_' || base AS match_id, label AS match_category, '/data/' || label || '/' || base || '.parquet' AS data_path,
         '/data/' || label || '/' || base || '.json' AS metadata_path, label,
         CASE WHEN label = 'no_cheater_present' THEN 'medium' WHEN n > 0 THEN 'high' ELSE 'uncertain' END AS label_confidence,
         CASE WHEN label = 'no_cheater_present' THEN 'cs2cd_unverified_no_vac' ELSE 'cs2cd_vac_verified' END AS label_source,
         coalesce(cheaters, '') AS cheaters, CAST(coalesce(n, 0) AS INTEGER) AS num_cheaters, TRUE AS usable_for_training
  FROM mm LEFT JOIN vv USING (base)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || match_id), match_id) AS r_i, count(*) OVER (PARTITION BY label) AS r_n,
         row_number() OVER (ORDER BY md5('42:' || match_id), match_id) AS a_i, count(*) OVER () AS a_n FROM man),
least_ AS (SELECT min(c) AS least_c FROM (SELECT count(*) AS c FROM man GROUP BY label)),
chosen AS (SELECT *, CASE WHEN a_n >= 6 AND least_c >= 2 THEN r_i ELSE a_i END AS i, CASE WHEN a_n >= 6 AND least_c >= 2 THEN r_n ELSE a_n END AS n FROM ranked, least_),
split_ AS (
  SELECT * EXCLUDE (i, n, r_i, r_n, a_i, a_n, least_c), CASE WHEN a_n < 3 THEN 'train' WHEN i <= n - ceil(n * 0.30::DOUBLE) THEN 'train'
         WHEN i <= n - ceil(ceil(n * 0.30::DOUBLE) / 2) THEN 'validation' ELSE 'test' END AS split FROM chosen)
"""


def labels(spark, sf):
    """Labelled players, written once. A label follows from the roster and the manifest, so no detector runs for it."""
    def build():
        people = results.roster(I.ticks(spark, sf)).withColumn("match_id", F.concat_ws("_", class_of_match(), "match_id"))
        return dataset.label_players(people, manifest_with_split(spark, sf), cheaters(spark, sf))

    return I.stored(spark, sf, "labels", build)


def labelled_features(spark, sf, m):
    rows = dataset.feature_rows(m.select(*PLAYER, *[c for c in m.columns if c.startswith("aim_")]),
                                m.select(*PLAYER, *[c for c in m.columns if c.startswith("bhop_")]),
                                m.select(*PLAYER, *[c for c in m.columns if c.startswith("wh_")]))
    rows = rows.withColumn("match_id", F.concat_ws("_", class_of_match(), "match_id"))
    return dataset.label_players(rows, manifest_with_split(spark, sf), cheaters(spark, sf))


def features(spark, sf):
    """Labelled feature rows, written once as a training run would keep them."""
    return I.stored(spark, sf, "features", lambda: labelled_features(spark, sf, I.feature_metrics(spark, sf)))


LABELS_SQL = I.METRICS_SQL + "," + MANIFEST_SQL.split(",\nver AS", 1)[1].join(["ver AS", ""]) + f""",
feats AS (
  SELECT s.match_id, metrics.steamid, s.match_category, s.split,
         CASE WHEN s.match_category = 'with_cheater_present' THEN CASE WHEN v.steamid IS NOT NULL THEN 1 ELSE -1 END ELSE 0 END AS label,
         s.match_id || '_' || metrics.steamid AS player_key, {', '.join(dataset.FEATURES)}
  FROM (SELECT *, {CLASS_SQL} || '_' || match_id AS mid FROM metrics) metrics JOIN split_ s ON metrics.mid = s.match_id
  LEFT JOIN ver v ON v.match_id = metrics.match_id AND v.steamid = metrics.steamid)
"""


def scored(spark, sf):
    """A fixed score with a label that depends on it, for every event."""
    v = F.pmod(F.col("value"), F.lit(100.0))
    return I.table(spark, sf, "events").select(
        "event_id", "event_type", (v / 100.0).alias("score"), (v + F.col("event_id") % 50 > 60).cast("int").alias("label"))


SCORED_SQL = """WITH scored AS (SELECT event_id, event_type, fmod(value, 100.0::DOUBLE) / 100.0::DOUBLE AS score,
  CAST(fmod(value, 100.0::DOUBLE) + event_id % 50 > 60 AS INTEGER) AS label FROM events)"""


def rates_sql(source):
    """Rates over tp, fp, tn, fn; the F1 is rounded before thresholds are compared."""
    return f"""SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
      round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0)
        / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1,
      round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 4) AS fnr, tp + fp + tn + fn AS n_samples FROM {source}"""


def counts_sql(thr, score="score"):
    return f"""count(*) FILTER ({score} >= {thr} AND label = 1) AS tp, count(*) FILTER ({score} >= {thr} AND label <> 1) AS fp,
      count(*) FILTER ({score} < {thr} AND label <> 1) AS tn, count(*) FILTER ({score} < {thr} AND label = 1) AS fn"""


def auc_sql(score):
    return f"""(SELECT round((sum(rk) FILTER (label = 1) - p * (p + 1) / 2) / nullif(p * q, 0), 4) FROM (
      SELECT label, (count(*) OVER (ORDER BY {score} ROWS UNBOUNDED PRECEDING) * 0 + rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2) AS rk,
             count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label <> 1) OVER () AS q FROM scored) GROUP BY p, q)"""


# --- dataset -----------------------------------------------------------------------------------------------------

@query("DST-1", I.with_sql(MANIFEST_SQL, "SELECT * FROM man"))
def dst1(spark, sf):
    return manifest(spark, sf)


@query("DST-3", I.with_sql(MANIFEST_SQL, """, q AS (SELECT least(4, (SELECT count(*) FROM man WHERE label = 'with_cheater_present')) AS w)
  SELECT 9 AS asked, match_id, label FROM ranked, q WHERE a_n <= 9 OR CASE WHEN label = 'with_cheater_present' THEN r_i <= w ELSE r_i <= 9 - w END
  UNION ALL SELECT 1000000, match_id, label FROM man"""))
def dst3(spark, sf):
    """A sample smaller than the manifest, and one that is larger and keeps everything."""
    m = manifest(spark, sf)
    small, all_ = (dataset.balanced_sample(m, n).select(F.lit(n).alias("asked"), "match_id", "label") for n in (9, 1_000_000))
    return small.unionByName(all_)


@query("DST-4", I.with_sql(MANIFEST_SQL, "SELECT match_id, label, split FROM split_"))
def dst4(spark, sf):
    return manifest_with_split(spark, sf).select("match_id", "label", "split")


@query("DST-5", I.with_sql(LABELS_SQL, """SELECT player_key, label, CASE label WHEN 1 THEN 'verified_cheater' WHEN 0 THEN 'probable_non_cheater' ELSE 'unknown' END AS label_text,
  CASE label WHEN 1 THEN 'high' WHEN 0 THEN 'medium' ELSE 'low' END AS label_confidence, label IN (0, 1) AS usable_for_training FROM feats"""))
def dst5(spark, sf):
    return labels(spark, sf).select("player_key", "label", "label_text", "label_confidence", "usable_for_training")


@query("DST-6", I.with_sql(LABELS_SQL, "SELECT split, player_key, label FROM feats WHERE label IN (0, 1)"))
def dst6(spark, sf):
    f = labels(spark, sf)
    out = None
    for s in ("train", "validation", "test"):
        d = dataset.supervised(f, s).select("split", "player_key", "label")
        out = d if out is None else out.unionByName(d)
    return out


@query("DST-7", I.with_sql(LABELS_SQL, f"SELECT player_key, {', '.join(dataset.FEATURES)} FROM feats"))
def dst7(spark, sf):
    return features(spark, sf).select("player_key", *dataset.FEATURES)


@query("DST-8", I.with_sql(LABELS_SQL, """SELECT match_id, substr(sha256(string_agg(steamid, ',' ORDER BY steamid)), 1, 16) AS names_hash, round(max(aim_p99), 4) AS aim_p99
  FROM feats GROUP BY 1"""))
def dst8(spark, sf):
    """Old feature name in, canonical name out; the schema hash over the names of a match."""
    old = features(spark, sf).withColumnRenamed("aim_p99", "aim_snap_max")
    # the names of one match are its roster
    return dataset.canonical_features(old).groupBy("match_id").agg(
        dataset.schema_hash_column(F.array_sort(F.collect_set("steamid"))).alias("names_hash"), stable_round(F.max("aim_p99"), 4).alias("aim_p99"))


@query("AGG-7", I.with_sql(LABELS_SQL, "SELECT split, label, count(*) AS count FROM feats GROUP BY 1, 2"))
def agg7(spark, sf):
    return dataset.population(labels(spark, sf))


@query("AGG-8", I.with_sql(I.BASE_SQL, f"""SELECT count(DISTINCT match_id) AS matches, count(DISTINCT match_id) FILTER ({K_SQL} % 5 = 4) AS failed,
  round(count(DISTINCT match_id) FILTER ({K_SQL} % 5 = 4) / count(DISTINCT match_id), 6) AS failure_rate,
  count(DISTINCT match_id) FILTER ({K_SQL} % 5 = 4) / count(DISTINCT match_id) > 0.30 AS too_many FROM ticks"""))
def agg8(spark, sf):
    t = I.ticks(spark, sf).withColumn("yaw", F.when(match_no() % 5 != 4, F.col("yaw")))
    return readers.extraction_gate(readers.match_status(t), CFG.max_failure_rate).withColumn(
        "failure_rate", stable_round("failure_rate", 6))


@query("JOIN-7", I.with_sql(LABELS_SQL, "SELECT match_id, steamid, label, split FROM feats"))
def join7(spark, sf):
    return labels(spark, sf).select(*PLAYER, "label", "split")


@query("JOIN-8", SCORED_SQL.replace("label FROM events)", "label, fmod(value * 3.0::DOUBLE, 100.0::DOUBLE) / 100.0::DOUBLE AS score_b FROM events)") + f"""
  , a AS (SELECT {counts_sql(0.6)} FROM scored), b AS (SELECT {counts_sql(0.5, 'score_b')} FROM scored)
  SELECT 'a' AS model, *, {auc_sql('score')} AS roc_auc FROM ({rates_sql('a')}) UNION ALL SELECT 'b', *, {auc_sql('score_b')} FROM ({rates_sql('b')})""")
def join8(spark, sf):
    d = scored(spark, sf)
    b = I.table(spark, sf, "events").select("event_id", (F.pmod(F.col("value") * 3.0, F.lit(100.0)) / 100.0).alias("score_b"))
    return evaluation.compare_models(d.join(b, "event_id"), "score", "score_b", 0.6, 0.5)


# --- evaluation --------------------------------------------------------------------------------------------------

THR_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in evaluation.THRESHOLDS)


@query("ML-5", SCORED_SQL + f""", t AS (SELECT * FROM (VALUES {THR_VALUES}) v(thr)),
  c AS (SELECT thr, {counts_sql('thr')} FROM scored, t GROUP BY thr), m AS ({rates_sql('c')}),
  best AS (SELECT thr FROM m ORDER BY f1 DESC, thr DESC LIMIT 1)
  SELECT round(thr, 2) AS threshold, tp, fp, tn, fn, f1, thr = (SELECT thr FROM best) AS is_best,
    round(least(0.40, greatest(0.05, (SELECT round(thr, 2) FROM best) - 0.10)), 2) AS threshold_suspect FROM m""")
def ml5(spark, sf):
    d = scored(spark, sf)
    best = one_row(evaluation.best_threshold(d).select("threshold", "threshold_suspect"))
    return evaluation.threshold_sweep(d).select("threshold", "tp", "fp", "tn", "fn", "f1", (F.col("threshold") == best["threshold"]).alias("is_best"),
                                                best["threshold_suspect"].alias("threshold_suspect"))


@query("ML-6", SCORED_SQL + f", c AS (SELECT event_type, {counts_sql(0.5)} FROM scored GROUP BY 1) {rates_sql('c')}")
def ml6(spark, sf):
    return evaluation.binary_metrics(scored(spark, sf), 0.5, by=("event_type",))


@query("ML-7", SCORED_SQL + f" SELECT {auc_sql('score')} AS roc_auc")
def ml7(spark, sf):
    return evaluation.roc_auc(scored(spark, sf))


# --- models ------------------------------------------------------------------------------------------------------

FIT_SQL = "(SELECT " + ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in dataset.FEATURES) + \
    " FROM feats WHERE split = 'train' AND label IN (0, 1)) AS fitted"


@query("ML-1", I.with_sql(LABELS_SQL, "SELECT player_key, " + ", ".join(
    f"round(coalesce(({f} - {f}_m) / nullif({f}_s, 0), 0), 4) AS {f}_z" for f in dataset.FEATURES) + f" FROM feats, {FIT_SQL}"))
def ml1(spark, sf):
    return training.scale(features(spark, sf)).select("player_key", *[stable_round(f"{f}_z", 4).alias(f"{f}_z") for f in dataset.FEATURES])


_MODELS: dict = {}


def train_rows(spark, sf):
    """Features of the players of the training split whose label is known. Where features are not written yet, labels come first and only these players are measured."""
    if I.is_stored(spark, sf, "features"):
        return dataset.supervised(features(spark, sf), "train")

    def build():
        who = dataset.supervised(labels(spark, sf), "train").select(F.expr("substring(match_id, length(match_category) + 2)").alias("match_id"), "steamid")
        return dataset.supervised(labelled_features(spark, sf, I.feature_metrics(spark, sf, materialize(who, "trained_on"), "train_metrics")), "train")

    return I.stored(spark, sf, "train_rows", build)


def forest(spark, sf):
    """Fitted once per application, on the training split."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = training.fit(train_rows(spark, sf))
    return _MODELS[key]


@query("ML-2", I.with_sql(LABELS_SQL, f"""SELECT label, count(*) AS trained_on, {CFG.n_trees} AS trees, {len(dataset.FEATURES)} AS features, TRUE AS importance_agrees,
  TRUE AS leaves_kept, TRUE AS depth_kept FROM feats WHERE split = 'train' AND label IN (0, 1) GROUP BY label"""))
def ml2(spark, sf):
    """Rows that the forest was fitted on, by label; whether its importances are those of its saved nodes, its leaves large and its trees flat enough."""
    fitted = forest(spark, sf).stages[-1]
    nodes = forests.saved_nodes(spark, fitted)
    said = fitted.featureImportances.toArray()
    found = {r["feature"]: r["importance"] for r in forests.importances(nodes).collect()}
    agrees = all(abs(said[i] - found.get(i, 0.0)) < 1e-6 for i in range(len(said)))
    smallest = nodes.where("feature < 0").agg(F.min("rows")).first()[0]
    deep = max(t.depth for t in fitted.trees)
    return train_rows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("trained_on")).select(
        "label", "trained_on", F.lit(fitted.getNumTrees).alias("trees"), F.lit(fitted.numFeatures).alias("features"), F.lit(agrees).alias("importance_agrees"),
        F.lit(smallest >= CFG.min_leaf).alias("leaves_kept"), F.lit(deep <= CFG.max_depth).alias("depth_kept"))


PAIRS = [(a, b) for a, b in zip(dataset.FEATURES[::2], dataset.FEATURES[1::2])]
MIDPOINT_SQL = ", tr AS (SELECT * FROM feats WHERE split = 'train' AND label IN (0, 1)), cuts AS (SELECT " + ", ".join(
    f"(min({f}) + max({f})) / 2 AS {f}_c" for f in dataset.FEATURES) + " FROM tr), bits AS (SELECT f.player_key, f.split, f.label, " + ", ".join(
    f"CASE WHEN {a} <= {a}_c THEN 0 ELSE 2 END + CASE WHEN {b} <= {b}_c THEN 0 ELSE 1 END AS leaf{i}" for i, (a, b) in enumerate(PAIRS)) + " FROM feats f, cuts)"


@query("ML-3", I.with_sql(LABELS_SQL, MIDPOINT_SQL + ", " + ", ".join(
    f"v{i} AS (SELECT leaf{i}, avg(label) AS share{i} FROM bits WHERE split = 'train' AND label IN (0, 1) GROUP BY 1)" for i in range(len(PAIRS))) +
    "\n  SELECT player_key, split, label, TRUE AS agrees, round(100 * (" + " + ".join(f"coalesce(share{i}, 0.5)" for i in range(len(PAIRS))) + f") / {len(PAIRS)}, 6) AS baseline_score FROM bits " +
    " ".join(f"LEFT JOIN v{i} USING (leaf{i})" for i in range(len(PAIRS)))))
def ml3(spark, sf):
    """Every score of the fitted forest is what a walk through its saved nodes gives, to nine digits, and in percent; the same walk scores a baseline forest, whose
    scores the SQL computes anew."""
    f, model = features(spark, sf), forest(spark, sf)
    nodes = materialize(forests.saved_nodes(spark, model.stages[-1]), "nodes")
    said = training.score(model, f).select("player_key", "split", "label", "ml_score")
    scaled = model.stages[1].transform(model.stages[0].transform(dataset.canonical_features(f)))
    walked = forests.walk(scaled, nodes, vector_to_array("scaled"), "player_key", CFG.max_depth).withColumnRenamed("value", "walked")
    plain = forests.midpoint_forest(train_rows(spark, sf), list(dataset.FEATURES))
    baseline = forests.walk(f, plain, F.array(*[F.col(c).cast("double") for c in dataset.FEATURES]), "player_key", 2)
    agrees = (F.abs(F.col("ml_score") - F.col("walked") * 100) < 1e-9) & F.col("ml_score").between(0, 100)
    return said.join(walked, "player_key", "left").join(baseline, "player_key", "left").select(
        "player_key", "split", "label", F.coalesce(agrees, F.lit(False)).alias("agrees"), stable_round(F.col("value") * 100, 6).alias("baseline_score"))


@query("ML-4", I.with_sql(LABELS_SQL, f"""SELECT 'tree' AS kind, CAST(t AS VARCHAR) AS name, least({CFG.iforest_sample}, (SELECT count(*) FROM feats WHERE split = 'train' AND label = 0)) AS value
    FROM range({CFG.iforest_trees}) r(t)
  UNION ALL SELECT 'fitted', 'rows', count(*) FROM feats WHERE split = 'train' AND label = 0
  UNION ALL SELECT 'fitted', 'few outliers', 1
  UNION ALL SELECT 'player', player_key, 1 FROM feats"""))
def ml4(spark, sf):
    """Sample size of each tree, rows fitted on, whether no more than the contamination lies below the offset, and for every player whether the anomaly score is what
    a walk through the stored nodes gives."""
    f, tr = features(spark, sf), train_rows(spark, sf)
    cols = [f"{c}_z" for c in dataset.FEATURES]
    clean = training.scale(f).where("split = 'train' and label = 0").select("player_key", *cols)
    n = clean.count()
    trees = training.tree_samples(clean, n).groupBy("tree").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("tree").alias("kind"), F.col("tree").cast("string").alias("name"), "value")
    fitted = training.fit_outliers(tr)
    found = training.score_outliers(fitted, f)
    below = F.count_if((F.col("split") == "train") & (F.col("label") == 0) & (F.col("decision") < 0))
    few = found.agg((below <= n * CFG.contamination + 1).cast("long").alias("value")).select(
        F.lit("fitted").alias("kind"), F.lit("few outliers").alias("name"), "value")
    rows = clean.agg(F.count(F.lit(1)).alias("value")).select(F.lit("fitted").alias("kind"), F.lit("rows").alias("name"), "value")
    # the same from the definition: mean path over all trees, its power of two, less the offset
    paths = forests.walk(training.scale(f), fitted["nodes"].withColumnRenamed("path", "value"), F.array(*cols), "player_key", (CFG.iforest_sample - 1).bit_length())
    raw = -F.pow(F.lit(2.0), -F.col("value") / training.mean_path(min(n, CFG.iforest_sample)))
    both = found.join(paths, "player_key", "left").withColumn("_gap", F.abs(F.col("decision") - (raw - one_row(fitted["offset"])["offset"])))
    agrees = (F.col("_gap") < 1e-9) & F.col("anomaly_score").between(0, 100)
    players = both.select(F.lit("player").alias("kind"), F.col("player_key").alias("name"), F.coalesce(agrees, F.lit(False)).cast("long").alias("value"))
    return trees.unionByName(rows).unionByName(few).unionByName(players)


def model_rows(spark, sf):
    """One metadata row per match, some of them wrong."""
    m = I.ticks(spark, sf).select("match_id").distinct().withColumn("k", match_no())
    names = F.array(*[F.lit(f) for f in dataset.FEATURES])
    return m.select(
        "match_id", F.when(F.col("k") % 4 == 1, F.slice(names, 1, 14)).when(F.col("k") % 4 == 2, F.concat(F.array(F.lit("x")), F.slice(names, 2, 14)))
        .otherwise(F.transform(names, lambda x: F.when(x == "aim_p99", F.lit("aim_snap_max")).otherwise(x))).alias("features"),
        F.when(F.col("k") % 7 == 3, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))).alias("classes"),
        F.when(F.col("k") % 3 != 0, F.col("k") % 5 * 0.25).alias("threshold_high"), F.lit(0.75).alias("threshold"), F.lit(0.4).alias("threshold_suspect"),
        F.concat(F.lit("set"), F.col("k").cast("string")).alias("dataset_name"), F.lit("2024-01-31").alias("training_date"))


@query("ML-9", I.with_sql(I.BASE_SQL, f""", m AS (SELECT DISTINCT match_id, {K_SQL} AS k FROM ticks),
  h AS (SELECT *, CASE WHEN k % 3 <> 0 THEN k % 5 * 0.25 ELSE 0.75 END AS high FROM m)
  SELECT match_id, concat_ws(',', CASE WHEN k % 4 = 1 THEN 'feature count' END, CASE WHEN k % 4 IN (1, 2) THEN 'feature schema' END,
    CASE WHEN k % 7 = 3 THEN 'classes' END, CASE WHEN NOT (0.4 < high AND high <= 1) THEN 'thresholds' END) AS problems FROM h"""))
def ml9(spark, sf):
    return training.check_metadata(model_rows(spark, sf)).select("match_id", F.array_join("problems", ",").alias("problems"))


@query("ML-10", I.with_sql(I.BASE_SQL, f""", m AS (SELECT DISTINCT match_id, {K_SQL} AS k FROM ticks)
  SELECT match_id, substr(sha256(concat_ws('|', 'set' || k, '2024-01-31', CASE WHEN k % 3 <> 0 THEN CAST((k % 5 * 0.25)::DOUBLE AS VARCHAR) END, '0.4',
    '{dataset.schema_hash()}', 'bytes')), 1, 16) AS fingerprint FROM m"""))
def ml10(spark, sf):
    return training.model_fingerprint(model_rows(spark, sf), "bytes").select("match_id", "fingerprint")
