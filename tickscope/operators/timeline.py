"""The per-player timeline: which rows count, their dense positions, and all tick-to-tick kinematics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.angles import angular_delta
from tickscope.operators.blocks import PLAYER, block_index, block_window, row_blocks

LAGS = 4           # a jerk is three lags deep, a turn within a rolling window one more
TRAJECTORY = 3     # rows before and after a snap


def halo(cfg: AnalysisConfig = DEFAULT) -> tuple[int, int]:
    """Rows before and after a block that its own rows look at."""
    return max(cfg.spin_window, cfg.jitter_window, TRAJECTORY) + LAGS, TRAJECTORY + 1


TICK_COLUMNS = ("match_id", "steamid", "name", "tick", "X", "Y", "Z", "pitch", "yaw", "team_num", "health",
                "spotted", "is_airborne", "velocity_X", "velocity_Y", "active_weapon_name")


def shot_ticks(fires: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Distinct (match, player, tick) inside [shot - before, shot + after] of an own shot.

    Ticks are integers, so the interval join is an equi-join on the enumerated ticks.
    """
    around = F.sequence(F.col("tick") - cfg.shot_before, F.col("tick") + cfg.shot_after)
    return fires.where("tick is not null").select(
        "match_id", F.col("user_steamid").alias("steamid"), F.explode(around).alias("tick")).distinct()


def mark_shots(ticks: DataFrame, fires: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds ``in_shot``: an own shot lies within [tick - after, tick + before].

    Shots travel with the ticks of their block (and of the next block when their window crosses the edge), so one
    exchange by (player, tick block) serves this window and the dense index that follows.
    """
    block = F.floor(F.col("tick") / cfg.tick_block).alias("_blk")
    edges = F.array_distinct(F.array(F.floor((F.col("tick") - cfg.shot_before) / cfg.tick_block),
                                     F.floor((F.col("tick") + cfg.shot_after) / cfg.tick_block)))
    # distinct first: repeated events must not pile up in one block
    shots = fires.where("tick is not null").select("match_id", F.col("user_steamid").alias("steamid"), "tick").distinct()
    shots = shots.select("*", F.lit(True).alias("_shot"), F.explode(edges).alias("_blk"))
    both = ticks.select("*", F.lit(False).alias("_shot"), block).unionByName(shots, allowMissingColumns=True)
    w = Window.partitionBy(*PLAYER, "_blk").orderBy("tick").rangeBetween(-cfg.shot_after, cfg.shot_before)
    return both.withColumn("in_shot", F.max("_shot").over(w)).where("not _shot").drop("_shot")


def timeline(ticks: DataFrame, profile: str = "tabular", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Rows a detector sees, with dense position ``row_i`` of ``row_n`` per player.

    tabular: alive rows, but all rows of a player who is never alive. replay: alive rows only.
    If ``in_shot`` is present, ``src_i`` of ``src_n`` and ``use_shot`` describe the rows the aim metrics use.
    """
    shots = "in_shot" in ticks.columns
    live = F.coalesce(F.col("health") > 0, F.lit(False))
    counters = {"all": F.lit(1), "alive": live}
    if shots:
        counters |= {"shot_all": F.col("in_shot"), "shot_alive": F.col("in_shot") & live}
    d = block_index(ticks, counters, PLAYER, ("tick",), cfg.tick_block)
    dead_only = (F.col("alive_n") == 0) if profile == "tabular" else F.lit(False)
    d = d.where(live | dead_only)

    def pick(a: str, b: str) -> Column:
        return F.when(dead_only, F.col(a)).otherwise(F.col(b))

    d = d.withColumns({"row_i": pick("all_i", "alive_i"), "row_n": pick("all_n", "alive_n")})
    if shots:
        d = d.withColumns({"_shot_i": pick("shot_all_i", "shot_alive_i"), "_shot_n": pick("shot_all_n", "shot_alive_n")})
        d = d.withColumn("use_shot", F.col("_shot_n") > cfg.shot_rows_min).withColumns({
            "src_i": F.when(F.col("use_shot"), F.col("_shot_i")).otherwise(F.col("row_i")),
            "src_n": F.when(F.col("use_shot"), F.col("_shot_n")).otherwise(F.col("row_n")),
        })
    return d.drop("_blk", "all_i", "all_n", "alive_i", "alive_n", "shot_all_i", "shot_all_n", "shot_alive_i", "shot_alive_n",
                  "_shot_i", "_shot_n")


def kinematics(rows: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Every tick-to-tick quantity of all detectors: one exchange, one sort.

    Columns nobody selects are pruned from the plan together with their window expressions.
    """
    w = block_window("row_i")
    roll = w.rowsBetween(-(cfg.spin_window - 1), 0)
    jit = w.rowsBetween(-(cfg.jitter_window - 1), 0)

    def lag(c):
        return F.lag(c, 1).over(w)

    contiguous = F.coalesce(F.col("gap") == 1, F.lit(False))

    def if_contiguous(x):
        return F.when(contiguous, F.coalesce(x, F.lit(0.0))).otherwise(0.0)

    d = row_blocks(rows, *halo(cfg), "row_i", cfg.row_block)
    d = d.withColumns({"gap": F.col("tick") - lag("tick"), "yaw_before": lag("yaw"), "pitch_before": lag("pitch")})
    d = d.withColumns({
        "d_yaw": if_contiguous(angular_delta("yaw_before", "yaw")),
        "d_pitch": if_contiguous(F.col("pitch") - F.col("pitch_before")),
        "raw_d_yaw": F.abs(angular_delta("yaw_before", "yaw")),
        "raw_d_pitch": F.abs(F.col("pitch") - F.col("pitch_before")),
        "yaw_step": F.abs(F.col("yaw") - F.col("yaw_before")),
    })
    d = d.withColumns({
        "speed": F.sqrt(F.col("d_yaw") * F.col("d_yaw") + F.col("d_pitch") * F.col("d_pitch")),
        "raw_speed": F.sqrt(F.col("raw_d_yaw") * F.col("raw_d_yaw") + F.col("raw_d_pitch") * F.col("raw_d_pitch")),
        "yaw_speed": F.abs("d_yaw"),
        "yaw_sign": F.signum("d_yaw"), "pitch_sign": F.signum("d_pitch"),
    })
    d = d.withColumns({
        "acceleration": F.abs(if_contiguous(F.col("speed") - lag("speed"))),
        "raw_jerk": F.coalesce(F.abs(F.col("raw_speed") - lag("raw_speed")), F.lit(0.0)),
        "_yaw_turn": F.coalesce(F.col("yaw_sign") != lag("yaw_sign"), F.lit(True)),
        "_pitch_turn": F.coalesce(F.col("pitch_sign") != lag("pitch_sign"), F.lit(True)),
        "spin_mean": F.when(F.col("row_i") >= cfg.spin_window, F.avg("yaw_speed").over(roll)),
        "pitch_var": F.when(F.col("row_i") >= cfg.jitter_window, F.var_samp("pitch").over(jit)),
    })
    d = d.withColumns({
        "jerk": F.abs(if_contiguous(F.col("acceleration") - lag("acceleration"))),
        "direction_change": F.col("_yaw_turn") & (F.abs("d_yaw") > cfg.micro_adjust_threshold) & contiguous,
        "pitch_turn": F.col("_pitch_turn") & contiguous,
        "yaw_flip": F.col("_yaw_turn") & (F.abs("d_yaw") > cfg.desync_angle) & contiguous,
    })
    d = d.withColumns({
        "pitch_turns": F.when(F.col("row_i") >= cfg.jitter_window,
                              F.sum(F.col("pitch_turn").cast("long")).over(jit)),
        "around": F.collect_list(F.struct("tick", "yaw", "pitch")).over(w.rowsBetween(-3, 3)),
    })
    if "is_airborne" in rows.columns:
        d = d.withColumns({"air": F.coalesce("is_airborne", F.lit(False)), "air_known": F.col("is_airborne").isNotNull()})
        d = d.withColumn("air_before", lag("air"))
    return d.where("_own").drop("_own", "_rb", "_yaw_turn", "_pitch_turn")
