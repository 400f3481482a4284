"""Spin / anti-aim detector: sustained rotation, impossible pitch, jitter and left-right flipping."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.numbers import stable_round
from tickscope.operators.blocks import PLAYER, consecutive_runs
from tickscope.operators.timeline import kinematics, timeline

METRICS = ("spinbot_yaw_speed_max", "spinbot_pitch_violations", "spinbot_jitter_score", "spinbot_desync_max_ticks",
           "spinbot_yaw_spin_windows")


def flip_runs(kin: DataFrame) -> DataFrame:
    """Runs of rows that flip the view by more than the desync angle on consecutive ticks."""
    return consecutive_runs(kin.where("yaw_flip").select(*PLAYER, "row_i"), "row_i", PLAYER)


def spin_metrics_of(kin: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    base = kin.groupBy(*PLAYER).agg(
        F.max("row_n").alias("rows"),
        F.coalesce(F.max("spin_mean"), F.lit(0.0)).alias("spin_max"),
        F.count_if(F.col("spin_mean") > cfg.spin_speed).alias("windows"),
        F.count_if(F.abs("pitch") > cfg.pitch_limit).alias("violations"),
        F.coalesce(F.max("pitch_var"), F.lit(0.0)).alias("jitter"),
        F.coalesce(F.max("pitch_turns"), F.lit(0)).alias("turns"))
    runs = flip_runs(kin).groupBy(*PLAYER).agg(F.max("run_len").alias("flips"))
    full = F.col("rows") >= cfg.spin_min_rows

    def count(c: str) -> Column:
        return F.when(full, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long")

    return base.join(runs, [*PLAYER], "left").select(
        *PLAYER,
        F.when(full, stable_round("spin_max", 4)).otherwise(0.0).alias("spinbot_yaw_speed_max"),
        count("violations").alias("spinbot_pitch_violations"),
        F.when(full, stable_round("jitter", 4)).otherwise(0.0).alias("spinbot_jitter_score"),
        count("flips").alias("spinbot_desync_max_ticks"),
        count("windows").alias("spinbot_yaw_spin_windows"),
        count("turns").alias("spinbot_pitch_turns_max"))


def spin_metrics(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular") -> DataFrame:
    return spin_metrics_of(kinematics(timeline(ticks, profile, cfg), cfg), cfg)


def is_spinning(cfg: AnalysisConfig = DEFAULT) -> Column:
    return ((F.col("spinbot_yaw_spin_windows") > 0) | (F.col("spinbot_pitch_violations") > 0)
            | (F.col("spinbot_jitter_score") > cfg.jitter_variance)
            | (F.col("spinbot_desync_max_ticks") >= cfg.desync_run))


def spin_events(metrics: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return metrics.where(is_spinning(cfg)).select(
        *PLAYER, F.lit("spinbot_detected").alias("type"), F.struct(*METRICS).alias("metrics"))
