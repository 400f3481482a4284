"""Alignment with opponents the player cannot see.

One equi-join on (match, tick) serves all players. Team, visibility and range are part of the join
condition, so pairs outside of them are never produced; the key holds one row per player of the lobby.
Ticks with more than ``crowd`` rows also join on a grid cell (side = maximal range).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.angles import angular_error, bearing, planar_distance
from tickscope.functions.numbers import stable_round
from tickscope.operators.blocks import PLAYER, block_index, block_window, consecutive_runs, row_blocks
from tickscope.operators.clean import not_dead
from tickscope.operators.timeline import kinematics, timeline
from tickscope.sources.workdir import Keep, lazy

TARGET = (*PLAYER, "target")
METRICS = ("wh_ratio_lock_cache", "wh_ratio_lock_strict", "wh_tracking_consecutif_max", "wh_distance_moyenne_verrous",
           "wh_preaim_score", "wh_info_timing_ratio")


def _cell(c: str, side: float, shift: int = 0) -> Column:
    return F.floor(F.col(c) / side) + shift


def with_first_team(ticks: DataFrame) -> DataFrame:
    """Side of a player = side of the first row, for parity with sources that never swap sides."""
    first = ticks.groupBy(*PLAYER).agg(F.min_by("team_num", "tick").alias("_team"))
    return ticks.join(first, [*PLAYER])


def sight_pairs(ticks: DataFrame, cfg: AnalysisConfig = DEFAULT, *, profile="tabular", team_mode="tick",
                alive_only=True, in_range=True, occluded=True, keep: Keep = lazy, viewers: DataFrame | None = None) -> DataFrame:
    """(player, opponent) of the same tick with distances and angular error. ``viewers``: the rows of the players who look, if not all do.

    Ticks with more than ``cfg.crowd`` rows are matched by grid cell too; the rows do not depend on it. Written with ``keep``, the table of those
    ticks has a known size, and rows are not exchanged to meet an empty one.
    """
    rows, views = ((not_dead(d) if alive_only else d) for d in (ticks, ticks if viewers is None else viewers))
    me_team = "team_num"
    if team_mode == "first":
        rows, views, me_team = with_first_team(rows), with_first_team(views), "_team"
    side = cfg.range_max
    if in_range:
        # few ticks or none: counted before the shuffle, and the table of crowded ticks is empty for ordinary matches
        crowded = rows.groupBy("match_id", "tick").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > cfg.crowd)
        crowded = keep(crowded, "crowded")
        rows, views = (d.join(crowded, ["match_id", "tick"], "left") for d in (rows, views))
        grid = F.col("_rows").isNotNull()
        around = F.array(*[F.struct(_cell("X", side, i).alias("cx"), _cell("Y", side, j).alias("cy"))
                           for i in (-1, 0, 1) for j in (-1, 0, 1)])
        none = F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))
        me = views.withColumn("_cell", F.explode(F.when(grid, around).otherwise(none)))
        en = rows.withColumn("_cell", F.when(grid, F.struct(_cell("X", side).alias("cx"), _cell("Y", side).alias("cy")))
                             .otherwise(none[0]))
    else:
        me, en = (d.withColumn("_cell", F.lit(0)) for d in (views, rows))
    me = me.select("match_id", "tick", "_cell", "steamid", F.col(me_team).alias("team_j"), F.col("X").alias("xj"),
                   F.col("Y").alias("yj"), F.col("Z").alias("zj"), "pitch", "yaw")
    if occluded:
        en = en.where("spotted = false")
    en = en.select("match_id", "tick", "_cell", F.col("steamid").alias("target"), F.col("name").alias("target_name"),
                   F.col("team_num").alias("team_e"), F.col("X").alias("xe"), F.col("Y").alias("ye"),
                   F.col("Z").alias("ze"), "spotted")
    dx, dy, dz = (F.col(f"{a}e") - F.col(f"{a}j") for a in "xyz")
    d2 = planar_distance(dx, dy)
    d3 = F.sqrt(d2 * d2 + dz * dz)
    opponent = (F.col("steamid") != F.col("target")) & F.coalesce(F.col("team_j") != F.col("team_e"), F.lit(True))
    near = (F.abs(dx) <= side) & (F.abs(dy) <= side) if in_range else F.lit(True)
    keys = (F.col("me.match_id") == F.col("en.match_id")) & (F.col("me.tick") == F.col("en.tick")) \
        & (F.col("me._cell") == F.col("en._cell"))
    yaw_to, pitch_to = bearing(dx, dy, dz)
    p = me.alias("me").join(en.alias("en"), keys & opponent & near).select(
        F.col("me.match_id").alias("match_id"), F.col("me.tick").alias("tick"), "steamid", "target", "target_name",
        "yaw", "pitch", "xe", "spotted", d2.alias("distance_2d"), d3.alias("distance"),
        angular_error(yaw_to, pitch_to, "yaw", "pitch").alias("error"))
    if not in_range:
        return p
    return p.where(F.col("distance" if profile == "replay" else "distance_2d").between(cfg.range_min, cfg.range_max))


def lock_counts(pairs: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    wide = F.col("error") < cfg.wide_angle
    return pairs.groupBy(*PLAYER).agg(
        F.count_if(wide).alias("wide"), F.count_if(F.col("error") < cfg.strict_angle).alias("strict"),
        F.count_if((F.col("distance") <= cfg.preaim_range) & (F.col("error") < cfg.preaim_angle)).alias("preaim"),
        F.avg(F.when(wide, F.col("distance"))).alias("wide_distance"))


def strict_runs(pairs: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Runs of consecutive ticks locked on one target."""
    return consecutive_runs(pairs.where(F.col("error") < cfg.strict_angle).select(*TARGET, "tick"), "tick", TARGET)


def active_runs(pairs: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """As ``strict_runs`` but only over lock rows where the view or the target moved since the previous lock row."""
    locks = pairs.where(F.col("error") < cfg.strict_angle).select(*TARGET, "tick", "yaw", "xe")
    d = block_index(locks, {"lock": F.lit(1)}, TARGET, ("tick",), cfg.tick_block)
    w = block_window("lock_i", TARGET)
    moved = (F.abs(F.col("yaw") - F.lag("yaw").over(w)) > cfg.motion_yaw) \
        | (F.abs(F.col("xe") - F.lag("xe").over(w)) > cfg.motion_pos)
    active = row_blocks(d, 1, 0, "lock_i", cfg.row_block).withColumn("_moved", moved).where("_own and _moved")
    return consecutive_runs(active.select(*TARGET, "tick"), "tick", TARGET).where("run_len >= 2")


def info_timing(kin: DataFrame, pairs: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Share of sudden turns (raw yaw step) with a wide lock within the turn window."""
    near = pairs.where(F.col("error") < cfg.wide_angle).select(
        *PLAYER, F.explode(F.sequence(F.col("tick") - cfg.turn_window, F.col("tick") + cfg.turn_window)).alias("tick")
    ).distinct().withColumn("_near", F.lit(1))
    turns = kin.where((F.col("yaw_step") > cfg.turn_angle) & (F.col("row_n") > cfg.turn_min_rows)).select(*PLAYER, "tick")
    return turns.join(near, [*PLAYER, "tick"], "left").groupBy(*PLAYER).agg(
        (F.count("_near") / F.count(F.lit(1))).alias("info_timing"))


def occlusion_metrics(ticks: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular", team_mode="tick",
                      alive_only=True, kin: DataFrame | None = None, keep: Keep = lazy, viewers: DataFrame | None = None) -> DataFrame:
    """``kin``: kinematics of the same ticks, if they are at hand (replay profile). ``viewers``: the rows of the players asked for, if not all are."""
    viewers = ticks if viewers is None else viewers
    pairs = sight_pairs(ticks, cfg, profile=profile, team_mode=team_mode, alive_only=alive_only, keep=keep, viewers=viewers)
    # all metrics look at small errors only: few pairs, read three times
    pairs = keep(pairs.where(F.col("error") < max(cfg.wide_angle, cfg.strict_angle, cfg.preaim_angle)).drop(
        "target_name", "pitch", "spotted"), "locks")
    replay = profile == "replay"
    counted = F.coalesce(F.col("health") > 0, F.lit(True)) if alive_only and "health" in ticks.columns else F.lit(True)
    rows = viewers.groupBy(*PLAYER).agg(F.count_if(counted).alias("rows"))
    runs = (active_runs if replay else strict_runs)(pairs, cfg).groupBy(*PLAYER).agg(F.max("run_len").alias("run"))
    out = rows.join(lock_counts(pairs, cfg), [*PLAYER], "left").join(runs, [*PLAYER], "left")
    if replay:
        kin = kinematics(timeline(viewers, "replay", cfg), cfg) if kin is None else kin
        out = out.join(info_timing(kin, pairs, cfg), [*PLAYER], "left")
    else:
        out = out.withColumn("info_timing", F.lit(0.0))
    full = F.col("rows") >= (cfg.occlusion_min_rows_replay if replay else 1)

    def ratio(c: str) -> Column:
        r = F.coalesce(F.try_divide(F.col(c), F.col("rows")), F.lit(0.0))
        return F.when(full, stable_round(r, 4)).otherwise(0.0)

    def val(c: str, digits: int) -> Column:
        return F.when(full, stable_round(F.coalesce(F.col(c), F.lit(0.0)), digits)).otherwise(0.0)

    return out.select(
        *PLAYER,
        ratio("wide").alias("wh_ratio_lock_cache"), ratio("strict").alias("wh_ratio_lock_strict"),
        val("run", 0).cast("double").alias("wh_tracking_consecutif_max"),
        val("wide_distance", 2).alias("wh_distance_moyenne_verrous"),
        (ratio("preaim") if replay else F.lit(0.0)).alias("wh_preaim_score"),
        F.when(F.coalesce("wide", F.lit(0)) > 0, val("info_timing", 4)).otherwise(0.0).alias("wh_info_timing_ratio"))


def lock_events(ticks: DataFrame, metrics: DataFrame, *, cfg: AnalysisConfig = DEFAULT, team_mode="tick",
                alive_only=True) -> DataFrame:
    """One event per flagged player: span of all hidden opponents, longest run, first opponent of the match.

    No pairs: hidden players are counted per tick and side, and only flagged players' rows meet the counts. The first opponent is
    that of the earliest row whose side is not the player's first one.
    """
    flagged = metrics.where((F.col("wh_ratio_lock_strict") > cfg.lock_event_ratio)
                            | (F.col("wh_tracking_consecutif_max") >= cfg.lock_event_run))
    rows = not_dead(ticks) if alive_only else ticks
    hidden = rows.where("spotted = false").groupBy("match_id", "tick", F.col("team_num").alias("_side")).agg(F.count(F.lit(1)).alias("_n"))
    mine = (with_first_team(rows) if team_mode == "first" else rows.withColumn("_team", F.col("team_num"))).join(
        flagged.select(*PLAYER), [*PLAYER], "left_semi").select(*PLAYER, "tick", "_team", "team_num", F.coalesce(~F.col("spotted"), F.lit(False)).alias("_self"))
    others = F.col("_n") - F.when(F.col("_self") & F.col("team_num").eqNullSafe(F.col("_side")), 1).otherwise(0)
    span = mine.join(hidden, ["match_id", "tick"]).where(F.coalesce(F.col("_team") != F.col("_side"), F.lit(True)) & (others > 0)).groupBy(
        *PLAYER).agg(F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"))
    own = rows.groupBy(*PLAYER).agg(F.min_by("team_num", "tick").alias("_first_side"))
    sides = rows.groupBy("match_id", F.col("team_num").alias("_side")).agg(F.min(F.struct("tick", F.col("steamid").alias("target"), F.col("name").alias("target_name"))).alias("_f"))
    first = flagged.select(*PLAYER).join(own, [*PLAYER]).join(sides, "match_id").where(
        F.coalesce(F.col("_first_side") != F.col("_side"), F.lit(True)) & (F.col("_f.target") != F.col("steamid"))).groupBy(*PLAYER).agg(F.min("_f").alias("first"))
    return flagged.join(span, [*PLAYER]).join(first, [*PLAYER], "left").select(
        *PLAYER, F.lit("wh_lock").alias("type"), "start_tick", "end_tick",
        F.col("wh_tracking_consecutif_max").cast("long").alias("duration_ticks"),
        F.col("first.target_name").alias("target_name"), F.col("first.target").alias("target_steamid"),
        stable_round("wh_distance_moyenne_verrous", 2).alias("distance"))
