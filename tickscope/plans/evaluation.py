"""Metrics and threshold choice as single aggregations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tickscope.functions.numbers import stable_round

from tickscope.functions.frames import one_row
from tickscope.operators.blocks import prefix_sums

THRESHOLD_STEPS = 19
THRESHOLDS = tuple(0.05 + 0.05 * k for k in range(THRESHOLD_STEPS))  # compared unrounded, reported rounded


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """tp, fp, tn, fn -> rates; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _rate(tp, tp + fp), _rate(tp, tp + fn)
    return counts.withColumns({
        "precision": stable_round(precision, digits), "recall": stable_round(recall, digits),
        "f1": stable_round(_rate(2 * precision * recall, precision + recall), digits),
        "fpr": stable_round(_rate(fp, fp + tn), digits), "fnr": stable_round(_rate(fn, fn + tp), digits),
        "n_samples": tp + fp + tn + fn})


def binary_metrics(scored: DataFrame, threshold: float = 0.5, label="label", score="score", by: tuple = ()) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return with_rates(scored.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn")))


def roc_auc(scored: DataFrame, label="label", score="score", digits: int = 4) -> DataFrame:
    """Exact area by ranks with ties, null for a single class.

    Equal scores are counted first; the running count of negatives goes block by block of the score, so
    neither the scores nor their ranks meet in one task.
    """
    pos = F.col(label) == 1
    block = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * 4096.0)
    g = scored.groupBy(block.alias("_blk"), F.col(score).alias("_s")).agg(
        F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    sizes = g.groupBy(F.lit(1).alias("_one"), "_blk").agg(F.sum("n").alias("n"))  # 4097 rows at most
    below = prefix_sums(sizes, ["_one"], ["n"]).select("_blk", F.col("n_before").alias("_before"))
    w = Window.partitionBy("_blk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = g.join(F.broadcast(below), "_blk").withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2.0))
    return d.agg(stable_round(F.try_divide(wins, F.sum("p") * F.sum("n")), digits).alias("roc_auc"))


def threshold_sweep(scored: DataFrame, label="label", score="score") -> DataFrame:
    """Metrics at 0.05 ... 0.95. Each row falls into one of twenty bins; suffix sums over the bins do the rest."""
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]),
                             lambda t: F.col(score) >= t))
    pos = F.col(label) == 1
    bins = scored.groupBy(passed.alias("step")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    # twenty rows at most from here on
    steps = bins.sparkSession.range(0, THRESHOLD_STEPS + 1, 1, 1).withColumnRenamed("id", "step")
    all_bins = steps.join(bins, "step", "left").fillna(0, ["p", "n"]).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy("step")
    up, down = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    c = all_bins.select("step", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"),
                        F.coalesce(F.sum("n").over(down), F.lit(0)).alias("tn"),
                        F.coalesce(F.sum("p").over(down), F.lit(0)).alias("fn")).where("step > 0")
    return with_rates(c.withColumn("threshold", stable_round(F.col("step") * 0.05, 2)).drop("step"))


def best_threshold(scored: DataFrame, label="label", score="score") -> DataFrame:
    """Best F1, the higher threshold on ties; a single class gives the neutral 0.50. Zero or one row."""
    sweep = threshold_sweep(scored, label, score)
    single = (F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0)
    best = sweep.orderBy(F.when(single, F.abs(F.col("threshold") - 0.5)).otherwise(-F.col("f1")), F.desc("threshold")).limit(1)
    suspect = stable_round(F.least(F.lit(0.40), F.greatest(F.lit(0.05), F.col("threshold") - 0.10)), 2)
    return best.withColumn("threshold_suspect", suspect).withColumn("single_class", single)


def require_threshold(row) -> float:
    """Driver-side gate on the one row of ``best_threshold``."""
    if row is None or row["n_samples"] == 0:
        raise RuntimeError("no validation rows: cannot choose a threshold")
    if not row["single_class"] and row["recall"] == 0.0:
        raise ValueError("recall is zero at the best threshold: the model finds no cheater")
    return float(row["threshold"])


def compare_models(test: DataFrame, score_a: str, score_b: str, thr_a: float, thr_b: float, label="label") -> DataFrame:
    """Both models on the same rows, one metrics row each."""
    def one(name, score, thr):
        auc = roc_auc(test, label, score)
        m = binary_metrics(test, thr, label, score).withColumn("roc_auc", one_row(auc)["roc_auc"])
        return m.select(F.lit(name).alias("model"), "*")

    return one("a", score_a, thr_a).unionByName(one("b", score_b, thr_b))
