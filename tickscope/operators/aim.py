"""Aim detector: speed, jerk, snaps and the shape of the aim path around own shots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.numbers import stable_round
from tickscope.operators.blocks import PLAYER, block_window, exact_percentile, row_blocks
from tickscope.operators.timeline import TRAJECTORY, kinematics, mark_shots, timeline
from tickscope.sources.workdir import Keep, lazy

# fixed values: orthogonal polynomials (degree 1 and 2) on eight equally spaced points, both of squared norm 168
LINEAR8 = (-7.0, -5.0, -3.0, -1.0, 1.0, 3.0, 5.0, 7.0)
QUADRATIC8 = (7.0, 1.0, -3.0, -5.0, -5.0, -3.0, 1.0, 7.0)
NORM8 = 168.0


def aim_rows(ticks: DataFrame, fires: DataFrame, profile="tabular", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Kinematics of every row the aim detector sees, with the shot-window marks."""
    return kinematics(timeline(mark_shots(ticks, fires, cfg), profile, cfg), cfg)


def source_rows(rows: DataFrame) -> DataFrame:
    """Rows the metrics use: the shot windows if they hold enough rows, else everything."""
    finite = [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("speed", "jerk", "yaw")]
    return rows.where("in_shot or not use_shot").select(
        *PLAYER, "tick", "src_i", "src_n", "row_n", "direction_change", *finite)


def path_shape(src: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds per row: mean of the next five speeds, and at the end of each block of eight rows the R2 of a
    quadratic fit of yaw (closed form over an orthogonal basis) with the range of the block."""
    if cfg.row_block % 8:
        raise ValueError("row_block must be a multiple of eight: blocks of eight rows are fitted inside it")
    w = block_window("src_i")
    eight = w.rowsBetween(-7, 0)
    pos = F.col("_pos")

    def weight(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (pos + 1).cast("int"))

    d = row_blocks(src, 0, 5, "src_i", cfg.row_block).withColumn("_pos", (F.col("src_i") - 1) % 8)
    d = d.withColumns({
        "next5": F.avg("speed").over(w.rowsBetween(1, 5)),
        "_c1": F.sum(weight(LINEAR8) * F.col("yaw")).over(eight),
        "_c2": F.sum(weight(QUADRATIC8) * F.col("yaw")).over(eight),
        "_ss": F.var_pop("yaw").over(eight) * 8.0,
        "_range": F.max("yaw").over(eight) - F.min("yaw").over(eight),
    })
    # the block that starts at s counts only if s < n - 8: the last full block of a multiple of eight is left out
    counts = (pos == 7) & (F.col("src_i") < F.col("src_n")) & (F.col("src_n") >= 10) \
        & (F.col("_range") > cfg.fit_min_range) & (F.col("_ss") > 1e-6)
    r2 = F.greatest(F.lit(0.0), (F.col("_c1") * F.col("_c1") + F.col("_c2") * F.col("_c2")) / NORM8 / F.col("_ss"))
    return d.where("_own").withColumn("fit_r2", F.when(counts, r2)).drop("_own", "_rb", "_pos", "_c1", "_c2", "_ss", "_range")


def basic_aggregates(cfg: AnalysisConfig = DEFAULT) -> list:
    return [
        F.max("row_n").alias("rows"),
        F.max("speed").alias("aim_vitesse_max"),
        F.avg("jerk").alias("aim_jerk_moyen"),
        F.max("jerk").alias("aim_jerk_max"),
        (F.avg(F.col("direction_change").cast("double")) * 100.0).alias("aim_ratio_micro_ajustements"),
        F.coalesce(F.var_samp("speed"), F.lit(0.0)).alias("aim_variance_vitesse"),
    ]


def shape_aggregates(cfg: AnalysisConfig = DEFAULT) -> list:
    snap = (F.col("speed") > cfg.fov_snap_speed) & (F.col("src_i") <= F.col("src_n") - 5)
    still = snap & (F.col("next5") < cfg.fov_still_speed)
    moving = (F.col("speed") > cfg.acquisition_speed) & (F.col("src_i") <= F.col("src_n") - 3)
    return [
        F.coalesce(F.try_divide(F.count_if(still), F.count_if(snap)), F.lit(0.0)).alias("aim_fov_lock_ratio"),
        F.coalesce(F.avg("fit_r2"), F.lit(0.0)).alias("aim_fit_polynomial_indicatif"),
        F.coalesce(F.avg(F.when(moving, F.col("speed"))), F.lit(0.0)).alias("aim_vitesse_acquisition"),
    ]


METRICS = ("aim_vitesse_max", "aim_p99", "aim_jerk_moyen", "aim_jerk_max", "aim_ratio_micro_ajustements",
           "aim_variance_vitesse", "aim_fov_lock_ratio", "aim_fit_polynomial_indicatif", "aim_vitesse_acquisition")


def aim_metrics_of(rows: DataFrame, cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy) -> DataFrame:
    src = keep(source_rows(rows), "aim_source")
    base = path_shape(src, cfg).groupBy(*PLAYER).agg(*basic_aggregates(cfg), *shape_aggregates(cfg))
    p99 = exact_percentile(src, "speed", 0.99, "aim_p99")
    full = F.col("rows") >= cfg.aim_min_rows
    return base.join(p99, [*PLAYER]).select(
        *PLAYER, *[F.when(full, stable_round(m, 4)).otherwise(0.0).alias(m) for m in METRICS])


def aim_metrics(ticks: DataFrame, fires: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular",
                keep: Keep = lazy) -> DataFrame:
    """One row per (match, player): nine metrics, all zero below the minimum number of rows."""
    return aim_metrics_of(aim_rows(ticks, fires, profile, cfg), cfg, keep)


def with_around(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds ``around``, three rows on each side, to stored rows: one exchange by blocks of positions, and none if the column is not read."""
    w, point = block_window("row_i"), F.struct("tick", "yaw", "pitch")
    near = F.array(*[F.lag(point, k).over(w) for k in range(TRAJECTORY, 0, -1)], point, *[F.lead(point, k).over(w) for k in range(1, TRAJECTORY + 1)])
    return row_blocks(rows, TRAJECTORY, TRAJECTORY, "row_i", cfg.row_block).withColumn(
        "around", F.filter(near, lambda x: x.isNotNull())).where("_own").drop("_own", "_rb")


def snap_events_of(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Rows whose raw step (no contiguity test) exceeds the snap threshold, with three rows on each side."""
    snaps = (rows if "around" in rows.columns else with_around(rows, cfg)).where(F.col("raw_speed") > cfg.snap_threshold)
    return snaps.select(
        *PLAYER, F.lit("aim_snap").alias("type"), "tick",
        stable_round("raw_speed", 2).alias("snap_angle"), stable_round("raw_d_yaw", 2).alias("delta_yaw"),
        stable_round("raw_d_pitch", 2).alias("delta_pitch"), stable_round("raw_jerk", 2).alias("jerk"),
        F.coalesce(F.col("active_weapon_name") if "active_weapon_name" in snaps.columns else F.lit(None).cast("string"),
                   F.lit("None")).alias("weapon"),
        F.col("around").alias("trajectory"))


def snap_events(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular") -> DataFrame:
    return snap_events_of(kinematics(timeline(ticks, profile, cfg), cfg), cfg)
