"""Jump detector: ground contact between jumps, perfect chains, air strafing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.angles import horizontal_speed
from tickscope.functions.numbers import stable_round
from tickscope.operators.blocks import PLAYER, block_index, block_window, consecutive_runs, row_blocks
from tickscope.operators.timeline import kinematics, timeline
from tickscope.sources.workdir import Keep, lazy

METRICS = ("bhop_total_sauts", "bhop_ratio_parfaits", "bhop_variance_sol", "bhop_chaine_max", "bhop_vitesse_moyenne",
           "bhop_autostrafe_correlation", "bhop_velocity_gain_max")

_KEPT = (*PLAYER, "tick", "yaw", "velocity_X", "velocity_Y", "row_i", "row_n", "air", "air_known")
PROFILED = (*PLAYER, "profile")


def jump_rows_of(kin: DataFrame, profile="tabular") -> DataFrame:
    """Adds takeoff / landing. Before the first row the player stood (replay) or was in the first state (tabular)."""
    start = F.lit(False) if profile == "replay" else F.col("air")
    before = F.coalesce("air_before", start)
    return kin.select(*_KEPT, (F.col("air") & ~before).alias("takeoff"), (~F.col("air") & before).alias("landing"),
                      horizontal_speed("velocity_X", "velocity_Y").alias("speed_2d"))


def jump_rows_of_both(kin: DataFrame) -> DataFrame:
    """Rows for both profiles at once, from the tabular timeline. The replay profile leaves out the rows of players who are never alive (``live`` is false)
    and may see one takeoff more, in a player's first row (``takeoff_replay``); all else is the same."""
    before = F.coalesce("air_before", F.col("air"))
    return kin.select(
        *_KEPT, (F.col("air") & ~before).alias("takeoff"), (~F.col("air") & before).alias("landing"), horizontal_speed("velocity_X", "velocity_Y").alias("speed_2d"),
        (F.col("air") & ~F.coalesce("air_before", F.lit(False))).alias("takeoff_replay"), F.coalesce(F.col("health") > 0, F.lit(False)).alias("live"))


def jump_rows(ticks: DataFrame, profile="tabular", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    return jump_rows_of(kinematics(timeline(ticks, profile, cfg), cfg), profile)


def ground_intervals(rows: DataFrame, cfg: AnalysisConfig = DEFAULT, keys: tuple = PLAYER) -> DataFrame:
    """Landing to next takeoff. The two alternate, so the landing after k takeoffs pairs with takeoff k+1."""
    steps = block_index(rows.where("takeoff or landing").select(*keys, "tick", "takeoff"),
                        {"jump": F.col("takeoff")}, keys, ("tick",), cfg.tick_block)
    pair = F.when(F.col("takeoff"), F.col("jump_i") - 1).otherwise(F.col("jump_i"))
    return steps.groupBy(*keys, pair.alias("jump")).agg(
        F.max(F.when(~F.col("takeoff"), F.col("tick"))).alias("landing_tick"),
        F.max(F.when(F.col("takeoff"), F.col("tick"))).alias("takeoff_tick"),
    ).where("landing_tick is not null and takeoff_tick is not null").withColumn(
        "ground_ticks", F.col("takeoff_tick") - F.col("landing_tick")).withColumn(
        "perfect", F.col("ground_ticks") <= cfg.perfect_ground_ticks)


def perfect_runs(intervals: DataFrame, keys: tuple = PLAYER) -> DataFrame:
    """Runs of consecutive perfect intervals, from first landing to last takeoff."""
    return consecutive_runs(intervals.where("perfect"), "jump", keys, [
        F.min("landing_tick").alias("start_tick"), F.max("takeoff_tick").alias("end_tick")])


def interval_stats(intervals: DataFrame, keys: tuple = PLAYER) -> DataFrame:
    return intervals.groupBy(*keys).agg(
        F.avg(F.col("perfect").cast("double")).alias("ratio"), F.var_pop("ground_ticks").alias("ground_var"))


def air_strafe(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Correlation of view turn and velocity turn, and best speed gain, between successive airborne rows."""
    d = block_index(rows.where("air"), {"air": F.lit(1)}, PLAYER, ("row_i",), cfg.tick_block)
    d = row_blocks(d, 1, 0, "air_i", cfg.row_block)
    w = block_window("air_i")
    heading = F.degrees(F.atan2("velocity_Y", "velocity_X"))
    d = d.withColumn("_h", heading).withColumns({
        "turn": F.col("yaw") - F.lag("yaw").over(w), "drift": F.col("_h") - F.lag("_h").over(w),
        "gain": F.col("speed_2d") - F.lag("speed_2d").over(w)}).where("_own")
    # a constant side makes the deviation product zero: no correlation instead of an ANSI error
    corr = F.try_divide(F.covar_pop("turn", "drift"), F.stddev_pop("turn") * F.stddev_pop("drift"))
    enough = (F.count(F.lit(1)) > cfg.strafe_min_air_rows)
    return d.groupBy(*PLAYER).agg(
        F.when(enough & (F.count("turn") > cfg.strafe_min_pairs), F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0)))
        .otherwise(0.0).alias("strafe"),
        F.when(enough, F.coalesce(F.max("gain"), F.lit(0.0))).otherwise(0.0).alias("gain"))


def bhop_metrics_of(rows: DataFrame, profile="tabular", cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy,
                    intervals: DataFrame | None = None) -> DataFrame:
    v2 = F.col("velocity_X") * F.col("velocity_X") + F.col("velocity_Y") * F.col("velocity_Y")
    replay = profile == "replay"
    mean_speed = F.avg("speed_2d") if replay else F.sqrt(F.avg(v2))
    base = rows.groupBy(*PLAYER).agg(
        F.max("row_n").alias("rows"), F.count_if("takeoff").alias("jumps"), F.count_if("air").alias("air_rows"),
        F.count_if("air_known").alias("known_rows"),
        F.coalesce(mean_speed, F.lit(0.0)).alias("mean_speed"))
    iv = keep(ground_intervals(rows, cfg), "intervals") if intervals is None else intervals
    out = base.join(interval_stats(iv), [*PLAYER], "left").join(
        perfect_runs(iv).groupBy(*PLAYER).agg(F.max("run_len").alias("chain")), [*PLAYER], "left")
    if replay:
        out = out.join(air_strafe(rows, cfg), [*PLAYER], "left")
    else:
        out = out.withColumns({"strafe": F.lit(0.0), "gain": F.lit(0.0)})
    return _finished(out, PLAYER, F.lit(replay), cfg)


def bhop_metrics_of_both(rows: DataFrame, cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy) -> DataFrame:
    """Metrics of both profiles (column ``profile``) from one frame of ``jump_rows_of_both``: players and jumps are aggregated once, with the profile as a key."""
    v2 = F.col("velocity_X") * F.col("velocity_X") + F.col("velocity_Y") * F.col("velocity_Y")
    base = rows.groupBy(*PLAYER).agg(
        F.max("row_n").alias("rows"), F.count_if("air").alias("air_rows"), F.count_if("air_known").alias("known_rows"), F.bool_or("live").alias("_live"),
        F.count_if("takeoff").alias("_jumps"), F.count_if("takeoff_replay").alias("_jumps_replay"),
        F.coalesce(F.sqrt(F.avg(v2)), F.lit(0.0)).alias("_speed"), F.coalesce(F.avg("speed_2d"), F.lit(0.0)).alias("_speed_replay"))

    def of_profiles(live: Column, *columns: tuple[str, str, str]) -> Column:
        """One struct per profile: (name, column in the tabular, in the replay profile)."""
        each = [F.struct(F.lit(p).alias("profile"), *[F.col(c[i]).alias(c[0]) for c in columns]) for i, p in ((1, "tabular"), (2, "replay"))]
        return F.inline(F.when(live, F.array(*each)).otherwise(F.array(each[0])))

    base = base.select(*PLAYER, "rows", "air_rows", "known_rows", of_profiles(F.col("_live"), ("jumps", "_jumps", "_jumps_replay"), ("mean_speed", "_speed", "_speed_replay")))
    steps = rows.where("takeoff or landing or takeoff_replay").select(
        *PLAYER, "tick", of_profiles(F.col("live"), ("takeoff", "takeoff", "takeoff_replay"), ("landing", "landing", "landing")))
    iv = keep(ground_intervals(steps, cfg, PROFILED), "intervals")
    air = air_strafe(rows.where("live"), cfg).withColumn("profile", F.lit("replay"))
    out = base.join(interval_stats(iv, PROFILED), [*PROFILED], "left").join(
        perfect_runs(iv, PROFILED).groupBy(*PROFILED).agg(F.max("run_len").alias("chain")), [*PROFILED], "left").join(air, [*PROFILED], "left")
    return _finished(out.fillna(0.0, ["strafe", "gain"]), PROFILED, F.col("profile") == "replay", cfg)


def _finished(out: DataFrame, keys: tuple, replay: Column, cfg: AnalysisConfig) -> DataFrame:
    """Guards, defaults and rounding."""
    min_rows = F.when(replay, cfg.bhop_min_rows_replay).otherwise(cfg.bhop_min_rows_tabular)
    min_jumps = F.when(replay, cfg.bhop_min_jumps_replay).otherwise(cfg.bhop_min_jumps_tabular)
    measured = (F.col("rows") >= min_rows) & (F.col("known_rows") > 0)  # a source without the flag has no profile
    one_state = (F.col("air_rows") == 0) | (F.col("air_rows") == F.col("rows"))
    jumps = F.when(~replay & one_state, 0).otherwise(F.col("jumps"))
    full = measured & (jumps >= min_jumps)

    def val(x, default):
        return F.when(full, F.coalesce(x, F.lit(default))).otherwise(F.lit(default))

    return out.select(
        *keys,
        F.when(measured, jumps).otherwise(0).cast("double").alias("bhop_total_sauts"),
        stable_round(val(F.col("ratio"), 0.0), 4).alias("bhop_ratio_parfaits"),
        stable_round(val(F.col("ground_var"), cfg.default_ground_variance), 4).alias("bhop_variance_sol"),
        val(F.col("chain").cast("double"), 0.0).alias("bhop_chaine_max"),
        stable_round(F.when(measured, F.col("mean_speed")).otherwise(0.0), 4).alias("bhop_vitesse_moyenne"),
        stable_round(val(F.col("strafe"), 0.0), 4).alias("bhop_autostrafe_correlation"),
        stable_round(val(F.col("gain"), 0.0), 4).alias("bhop_velocity_gain_max"))


def bhop_metrics(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular", keep: Keep = lazy) -> DataFrame:
    return bhop_metrics_of(keep(jump_rows(ticks, profile, cfg), "jump_rows"), profile, cfg, keep)


def bhop_metrics_both(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy) -> DataFrame:
    kin = kinematics(timeline(ticks, "tabular", cfg), cfg)
    return bhop_metrics_of_both(keep(jump_rows_of_both(kin), "jump_rows"), cfg, keep)


def chain_events_of(rows: DataFrame, cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy, intervals: DataFrame | None = None,
                    metrics: DataFrame | None = None) -> DataFrame:
    """Chains of at least ``chain_event`` perfect jumps, only where the metrics are defined. ``intervals`` and ``metrics`` of the same rows, if they are at hand."""
    iv = keep(ground_intervals(rows, cfg), "intervals") if intervals is None else intervals
    m = (bhop_metrics_of(rows, "tabular", cfg, intervals=iv) if metrics is None else metrics).where(F.col("bhop_chaine_max") >= cfg.chain_event).select(
        *PLAYER, stable_round("bhop_vitesse_moyenne", 2).alias("avg_speed"))
    runs = perfect_runs(iv).where(F.col("run_len") >= cfg.chain_event)
    return runs.join(m, [*PLAYER]).select(
        *PLAYER, F.lit("bhop_chain").alias("type"), "start_tick", "end_tick",
        F.col("run_len").alias("chain_length"), "avg_speed")


def chain_events(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, keep: Keep = lazy) -> DataFrame:
    return chain_events_of(keep(jump_rows(ticks, "tabular", cfg), "jump_rows"), cfg, keep)
