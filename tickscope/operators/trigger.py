"""Trigger detector: time between the view meeting a target and the shot."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.angles import ray_hits_sphere, ticks_to_ms
from tickscope.functions.numbers import stable_round
from tickscope.operators.blocks import PLAYER, block_index, block_window, consecutive_runs, row_blocks
from tickscope.operators.clean import not_dead
from tickscope.sources.workdir import Keep, lazy

METRICS = ("triggerbot_rt_median", "triggerbot_rt_std", "triggerbot_rt_min", "triggerbot_burst_count",
           "triggerbot_total_shots_analyzed")


def burst_starts(ticks: DataFrame, firing: str = "is_firing", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """First tick of each firing run; the very first run counts only if there is no other."""
    f = ticks.where(F.coalesce(F.col(firing), F.lit(False))).select(*PLAYER, "tick")
    d = block_index(f, {"fire": F.lit(1)}, PLAYER, ("tick",), cfg.tick_block)
    d = row_blocks(d, 1, 0, "fire_i", cfg.row_block)
    d = d.withColumn("_start", F.coalesce(F.col("tick") - F.lag("tick").over(block_window("fire_i")) > 1, F.lit(False)))
    d = d.where("_own and (_start or fire_i = 1)")
    later = d.groupBy(*PLAYER).agg(F.count_if("_start").alias("_later"))
    return d.join(later, [*PLAYER]).where("_start or _later = 0").select(*PLAYER, "tick")


def shots_of(*sources: DataFrame) -> DataFrame:
    """Distinct shot ticks per player from the first source that knows the player."""
    ranked = None
    for rank, s in enumerate(sources):
        s = s.select(*PLAYER, "tick", F.lit(rank).alias("_src"))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = ranked.groupBy(*PLAYER).agg(F.min("_src").alias("_src"))
    return ranked.join(best, [*PLAYER, "_src"]).select(*PLAYER, "tick").distinct()


def _state(rows: DataFrame, prefix: str, who: str, more: list[str]) -> DataFrame:
    cols = ["X", "Y", "Z"] + (["yaw", "pitch"] if prefix == "j" else [])
    return rows.select("match_id", "tick", F.col("steamid").alias(who), F.col("team_num").alias(f"team_{prefix}"),
                       *[F.col(c).alias(f"{c.lower()}{prefix}" if c in "XYZ" else c) for c in cols], *more)


def _aligned(radius: float, cfg: AnalysisConfig):
    return ray_hits_sphere("xj", "yj", "zj", "yaw", "pitch", "xe", "ye", "ze", radius, cfg.eye_height)


#: Cells per side of the grid that is laid over the players of a crowded tick.
GRID = 32


def _at_shots(rows: DataFrame, shots: DataFrame, radius: float, cfg: AnalysisConfig) -> DataFrame:
    """Rows of the ticks in which somebody shoots; in crowded ticks with the low corner and the side of a cell of a grid over the players. Ordinary
    matches have no such tick. Ticks are exchanged once, and only these rows go further."""
    at = rows.join(shots.select("match_id", "tick").distinct(), ["match_id", "tick"], "left_semi")
    w = Window.partitionBy("match_id", "tick")
    lows = {"_x0": F.min("X").over(w), "_y0": F.min("Y").over(w)}
    at = at.select("match_id", "tick", "steamid", "team_num", "X", "Y", "Z", "yaw", "pitch", F.count(F.lit(1)).over(w).alias("_n"),
                   F.max("X").over(w).alias("_x1"), F.max("Y").over(w).alias("_y1"), *[c.alias(n) for n, c in lows.items()])
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    side = F.when(F.col("_n") > cfg.crowd, F.greatest(extent / GRID, F.lit(2.0 * radius), F.lit(1e-6)))
    return at.withColumn("_side", side).drop("_n", "_x1", "_y1")


def _index(place: str, low: str) -> str:
    return f"cast(floor(greatest(least(({place} - {low}) / _side, {GRID + 2}D), -2D)) as int)"


def _cells_of_sphere(radius: float) -> Column:
    """The cells, four at most, that a head's outline touches seen from above; a little wider, so that rounding loses none."""
    r = f"({radius}D + _side * 1e-6D)"
    x, y = (f"sequence({_index(f'{c} - {r}', low)}, {_index(f'{c} + {r}', low)})" for c, low in (("xe", "_x0"), ("ye", "_y0")))
    return F.expr(f"flatten(transform({x}, i -> transform({y}, j -> named_struct('i', i, 'j', j))))")


def _cells_of_ray() -> Column:
    """The cells that the view ray (direction _dx, _dy seen from above) crosses, column by column: about two for each column and row of the grid."""
    steep, edge = "abs(_dx) < 1e-9D", GRID + 1  # heads at the border of the players' rectangle reach one cell beyond it
    i0, j0 = _index("xj", "_x0"), _index("yj", "_y0")

    def height(x: str) -> str:
        """The ray's y over ``x``, not before its start."""
        return f"yj + greatest(({x} - xj) / if({steep}, 1D, _dx), 0D) * _dy"

    a, b = (_index(height(f"(_x0 + (i + {k}) * _side)"), "_y0") for k in (0, 1))
    lo = f"greatest(if({steep}, if(_dy < 0, -1, {j0}), least({a}, {b})), -1)"
    hi = f"least(if({steep}, if(_dy < 0, {j0}, {edge}), greatest({a}, {b})), {edge})"
    rows = f"if({lo} <= {hi}, transform(sequence({lo}, {hi}), j -> named_struct('i', i, 'j', j)), null)"
    columns = f"sequence({i0}, if({steep}, {i0}, if(_dx > 0, {edge}, -1)))"
    return F.expr(f"if(_dx is not null and xj is not null and yj is not null, flatten(filter(transform({columns}, i -> {rows}), c -> c is not null)), null)")


def shot_targets(ticks: DataFrame, shots: DataFrame, *, cfg: AnalysisConfig = DEFAULT, radius: float | None = None,
                 team_mode="tick", keep: Keep = lazy) -> DataFrame:
    """First living opponent (by id) whose head the view ray meets at the shot tick.

    Ticks with more than ``cfg.crowd`` players are split by place: a grid over the players, heads in the cells they touch, and the ray in the cells it
    crosses. Rays and heads of different cells never meet, and the exact test follows, so the grid decides the work and never the result.
    """
    radius = cfg.head_radius if radius is None else radius
    rows = not_dead(ticks)
    at = keep(_at_shots(rows, shots, radius, cfg), "at_shots")
    grid = ["_x0", "_y0", "_side"]
    turned = F.when(F.cos(F.radians("pitch")) < 0, 180.0).otherwise(0.0)  # a view past the zenith looks backwards
    yaw = F.when(F.col("pitch").isNotNull(), F.radians(F.col("yaw") + turned))
    me = _state(at, "j", "steamid", grid).join(shots, [*PLAYER, "tick"]).withColumns({"_dx": F.cos(yaw), "_dy": F.sin(yaw)})
    if team_mode == "first":
        first = rows.groupBy(*PLAYER).agg(F.min_by("team_num", "tick").alias("team_j"))
        me = me.drop("team_j").join(first, [*PLAYER])
    nowhere = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))

    def placed(d: DataFrame, cells: Column) -> DataFrame:
        return d.withColumn("_cell", F.explode(F.when(F.col("_side").isNull(), nowhere).otherwise(cells))).drop(*grid, "_dx", "_dy")

    en = placed(_state(at, "e", "target", grid), _cells_of_sphere(radius))
    me = placed(me, _cells_of_ray())
    cond = (F.col("me.match_id") == F.col("en.match_id")) & (F.col("me.tick") == F.col("en.tick")) & (F.col("me._cell") == F.col("en._cell")) \
        & (F.col("steamid") != F.col("target")) & F.coalesce(F.col("team_j") != F.col("team_e"), F.lit(True)) \
        & _aligned(radius, cfg)
    return me.alias("me").join(en.alias("en"), cond).groupBy(
        F.col("me.match_id").alias("match_id"), "steamid", F.col("me.tick").alias("tick")).agg(
        F.min("target").alias("target"))


def reaction_times(ticks: DataFrame, targets: DataFrame, *, cfg: AnalysisConfig = DEFAULT,
                   radius: float | None = None) -> DataFrame:
    """Walk back over the player's rows while the view stays on the target; a miss or a missing target row ends it.

    A hit asks for the rows of two players over ``lookback`` ticks. It travels to the blocks of that many ticks it touches, two at most, once for each of the two,
    and meets their rows there: ticks are exchanged once and nothing is enumerated per tick. Rows of one hit then come together,
    at most two per tick.
    """
    radius = cfg.head_radius if radius is None else radius
    span = cfg.lookback
    shot = F.col("tick")
    blocks = F.array_distinct(F.array(F.expr(f"tick div {span}"), F.expr(f"(tick - {span - 1}) div {span}")))
    who = F.array(F.struct(F.col("steamid").alias("p"), F.lit(True).alias("shooter")), F.struct(F.col("target").alias("p"), F.lit(False).alias("shooter")))
    asked = targets.select("match_id", F.col("steamid").alias("_me"), "target", shot.alias("shot_tick"), F.explode(blocks).alias("_block"), who.alias("_who")).select(
        "match_id", "_me", "target", "shot_tick", "_block", F.inline("_who")).withColumnRenamed("p", "steamid")
    rows = not_dead(ticks).select("match_id", "steamid", F.expr(f"tick div {span}").alias("_block"), "tick", "X", "Y", "Z", "yaw", "pitch")
    met = rows.join(asked, ["match_id", "steamid", "_block"]).where(F.col("tick").between(F.col("shot_tick") - (span - 1), F.col("shot_tick")))
    hit = ["match_id", "_me", "target", "shot_tick"]

    def of(shooter: bool, c: str) -> Column:
        return F.max(F.when(F.col("shooter") == F.lit(shooter), F.col(c)))

    both = met.repartition(*hit).groupBy(*hit, "tick").agg(
        F.max("shooter").alias("_seen"), *[of(True, c).alias(f"{c.lower()}j") for c in "XYZ"], *[of(False, c).alias(f"{c.lower()}e") for c in "XYZ"],
        *[of(True, c).alias(c) for c in ("yaw", "pitch")]).where("_seen")
    on = both.select(*hit, (F.col("shot_tick") - F.col("tick")).alias("ago"), F.coalesce(_aligned(radius, cfg), F.lit(False)).alias("on"))
    g = on.groupBy(*hit).agg(
        F.min(F.when(~F.col("on"), F.col("ago"))).alias("miss"),
        F.collect_list(F.when(F.col("on"), F.col("ago"))).alias("hits"))
    since = F.array_max(F.filter("hits", lambda a: a < F.coalesce(F.col("miss"), F.lit(span))))
    return g.select("match_id", F.col("_me").alias("steamid"), "shot_tick", "target", F.coalesce(since, F.lit(0)).alias("ticks_aligned")).withColumn(
        "reaction_ms", ticks_to_ms("ticks_aligned", cfg.tickrate))


def fast_bursts(reactions: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Number of runs of fast shots, counted once per run."""
    d = block_index(reactions, {"shot": F.lit(1)}, PLAYER, ("shot_tick",), cfg.tick_block)
    runs = consecutive_runs(d.where(F.col("reaction_ms") < cfg.burst_ms).select(*PLAYER, "shot_i"), "shot_i", PLAYER)
    return runs.groupBy(*PLAYER).agg(F.count_if(F.col("run_len") >= cfg.burst_len).alias("bursts"))


def trigger_metrics_of(reactions: DataFrame, roster: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """A reaction has at most 64 distinct values, so the exact median keeps a tiny buffer."""
    stats = reactions.groupBy(*PLAYER).agg(
        stable_round(F.percentile("reaction_ms", F.lit(0.5)), 2).alias("m"), stable_round(F.stddev_pop("reaction_ms"), 2).alias("s"),
        stable_round(F.min("reaction_ms"), 2).alias("lo"), F.count(F.lit(1)).alias("n"))
    out = roster.join(stats, [*PLAYER], "left").join(fast_bursts(reactions, cfg), [*PLAYER], "left")
    return out.select(
        *PLAYER, *[F.coalesce(F.col(c), F.lit(0.0)).alias(a) for c, a in zip(("m", "s", "lo"), METRICS)],
        F.coalesce("bursts", F.lit(0)).cast("long").alias(METRICS[3]), F.coalesce("n", F.lit(0)).cast("long").alias(METRICS[4]))


def trigger_metrics(ticks: DataFrame, shots: DataFrame, *, cfg: AnalysisConfig = DEFAULT, radius: float | None = None,
                    team_mode="tick", keep: Keep = lazy) -> DataFrame:
    hit = shot_targets(ticks, shots, cfg=cfg, radius=radius, team_mode=team_mode, keep=keep)
    reactions = keep(reaction_times(ticks, hit, cfg=cfg, radius=radius), "reactions")
    return trigger_metrics_of(reactions, ticks.select(*PLAYER).distinct(), cfg)


def trigger_flags(metrics: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """One row per flag: reason and value."""
    n, med, std, bursts = (F.col(c) for c in (METRICS[4], METRICS[0], METRICS[1], METRICS[3]))

    def flag(cond, reason, value):
        return F.when(cond, F.struct(F.lit(reason).alias("reason"), value.cast("double").alias("value")))

    flags = F.array(
        flag((n > 0) & (med < cfg.reaction_median_ms), "Anomalously fast median reaction time", med),
        flag((n >= cfg.trigger_min_shots) & (std < cfg.reaction_std_ms),
             "Statistically improbable consistency (std dev)", std),
        flag((n > 0) & (bursts > 0), "Sub-tick burst reaction pattern detected", bursts))
    return metrics.select(*PLAYER, F.inline(F.filter(flags, lambda x: x.isNotNull())))
