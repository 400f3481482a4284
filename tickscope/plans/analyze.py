"""End-to-end analysis: ticks and shots in, metrics, verdicts and event timeline out, for all matches in one job."""

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.operators import aim, bhop, occlusion, results, rules, spin, trigger
from tickscope.operators.blocks import PLAYER
from tickscope.operators.clean import deduplicate_ticks
from tickscope.operators.timeline import kinematics, mark_shots, timeline
from tickscope.sources.ticks import SOURCE, clean_ticks
from tickscope.plans.dataset import FEATURES
from tickscope.sources.workdir import Keep, WorkScope, lazy, materialize

KIN_COLUMNS = (*PLAYER, "tick", "yaw", "velocity_X", "velocity_Y", "pitch", "row_i", "row_n", "in_shot", "use_shot",
               "src_i", "src_n", "speed", "jerk", "direction_change", "raw_speed", "raw_d_yaw", "raw_d_pitch", "raw_jerk",
               "spin_mean", "pitch_var", "pitch_turns", "yaw_flip", "yaw_step", "air", "air_known", "air_before", "active_weapon_name")


def prepare(raw: DataFrame) -> DataFrame:
    """Cleaned ticks, one row per (match, tick, player): the first of its file."""
    return deduplicate_ticks(clean_ticks(raw), SOURCE).drop(*SOURCE)


class Analysis(NamedTuple):
    """Results of all matches: a row per player, per match, per event of the timeline."""

    players: DataFrame
    matches: DataFrame
    events: DataFrame


def own_shots(fires: DataFrame) -> DataFrame:
    return fires.select("match_id", F.col("user_steamid").alias("steamid"), "tick").where("tick is not null").distinct()


def shots_from(ticks: DataFrame, fires: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Shots of each player from the first source that has any: fire events, else the starts of firing runs in the ticks."""
    events = own_shots(fires)
    return trigger.shots_of(events, trigger.burst_starts(ticks, cfg=cfg)) if "is_firing" in ticks.columns else events


def kinematic_rows(ticks: DataFrame, fires: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular") -> DataFrame:
    return kinematics(timeline(mark_shots(ticks, fires, cfg), profile, cfg), cfg).select(*KIN_COLUMNS)


DETECTORS = ("aim", "bhop", "spin", "occlusion", "trigger")
#: Columns of the kinematics that a detector reads, beside player and tick.
READ_BY = {
    "aim": ("yaw", "row_n", "in_shot", "use_shot", "src_i", "src_n", "speed", "jerk", "direction_change"),
    "bhop": ("yaw", "velocity_X", "velocity_Y", "row_i", "row_n", "air", "air_known", "air_before"),
    "spin": ("pitch", "row_i", "row_n", "spin_mean", "pitch_var", "pitch_turns", "yaw_flip"),
    "occlusion": ("row_n", "yaw_step"),
    "trigger": (),
}


def player_metrics(ticks: DataFrame, fires: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular",
                   radius: float | None = None, stored: bool = True, kin: DataFrame | None = None, keep: Keep | None = None,
                   detectors: Sequence[str] = DETECTORS, of: DataFrame | None = None, shots: DataFrame | None = None,
                   intervals: DataFrame | None = None) -> DataFrame:
    """All five detectors (or those named), one row per (match, player), of the players ``of`` or of all; the others are still opponents.

    What several aggregations read (kinematics, jump intervals, locks, reactions) is written once
    (``stored``, or with ``keep``) and scanned narrowly after that. ``kin``, ``shots`` and ``intervals`` between jumps: written ones, if they are at hand.
    """
    keep = keep or (materialize if stored else lazy)
    shots, mine = shots_from(ticks, fires, cfg) if shots is None else shots, ticks
    if of is not None:
        shots, mine = shots.join(of, [*PLAYER], "left_semi"), keep(ticks.join(of, [*PLAYER], "left_semi"), "rows_of")
    if kin is None:
        read = {c for name in detectors for c in READ_BY[name]}
        kin = kinematic_rows(mine, shots.withColumnRenamed("steamid", "user_steamid"), cfg=cfg, profile=profile)
        kin = keep(kin.select(*PLAYER, "tick", *[c for c in KIN_COLUMNS if c in read]), "kinematics")
    builders = {
        "aim": lambda: aim.aim_metrics_of(kin, cfg),  # a filter of the kinematics: not written again
        "bhop": lambda: bhop.bhop_metrics_of(bhop.jump_rows_of(kin, profile), profile, cfg, keep, intervals),
        "spin": lambda: spin.spin_metrics_of(kin, cfg),
        "occlusion": lambda: occlusion.occlusion_metrics(ticks, cfg=cfg, profile=profile, kin=kin, keep=keep, viewers=mine),
        "trigger": lambda: trigger.trigger_metrics(ticks, shots, cfg=cfg, radius=radius, keep=keep),
    }
    # the written intermediates of the detectors are independent jobs: submit them together
    with ThreadPoolExecutor(len(detectors)) as pool:
        parts = list(pool.map(lambda name: builders[name](), detectors))
    out = results.roster(mine)
    for p in parts:
        out = out.join(p, [*PLAYER], "left")
    return out


def judge(metrics: DataFrame, *, cfg: AnalysisConfig = DEFAULT, model: DataFrame | None = None,
          ml_score="ml_score") -> DataFrame:
    """Flags, score, verdict; without a score column the score is 0 and the rules decide. ``model``: metadata with thresholds."""
    if ml_score not in metrics.columns:
        metrics = metrics.withColumn(ml_score, F.lit(0.0))
    d = rules.with_thresholds(rules.with_flags(metrics, cfg), model, cfg)
    return rules.normalize_result(rules.with_verdict(rules.with_score(d, cfg), cfg))


def combat_events(ticks: DataFrame, fires: DataFrame, metrics: DataFrame, *, cfg: AnalysisConfig = DEFAULT,
                  profile="tabular", kin: DataFrame | None = None, keep: Keep = materialize, intervals: DataFrame | None = None) -> DataFrame:
    """``intervals`` between jumps: written ones, if they and the ``metrics`` come from the same kinematics and ``cfg``."""
    if kin is None:
        kin = keep(kinematic_rows(ticks, fires, cfg=cfg, profile=profile), "kinematics")
    kinds = [aim.snap_events_of(kin, cfg),
             bhop.chain_events_of(bhop.jump_rows_of(kin, profile), cfg, keep, intervals, None if intervals is None else metrics),
             occlusion.lock_events(ticks, metrics, cfg=cfg),
             spin.spin_events(metrics, cfg),
             trigger.trigger_flags(metrics, cfg).withColumn("type", F.lit("triggerbot_event"))]
    if profile == "replay":  # the replay profile reports no chains and no locks
        kinds = [kinds[0], kinds[3], kinds[4]]
    return results.event_timeline(*kinds, keep=keep)


def analyse(ticks: DataFrame, fires: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular", radius: float | None = None,
            model: dict | None = None, keep: Keep = materialize) -> Analysis:
    """Players with scores, flags and verdicts, matches, and the event timeline, from one written kinematics.

    ``model``: a bundle of ``training.load_bundle``; its forest gives ``ml_score``, its isolation forest ``anomaly_score``, its metadata the
    thresholds. A player whose features are incomplete has no score: rules may still decide, otherwise data are insufficient.
    """
    shots = keep(shots_from(ticks, fires, cfg), "shots")
    by_user = shots.withColumnRenamed("steamid", "user_steamid")
    kin = keep(kinematic_rows(ticks, by_user, cfg=cfg, profile=profile), "kinematics")
    iv = keep(bhop.ground_intervals(bhop.jump_rows_of(kin, profile), cfg), "intervals")
    m = keep(player_metrics(ticks, fires, cfg=cfg, profile=profile, radius=radius, kin=kin, keep=keep, shots=shots, intervals=iv), "metrics")
    scored = m
    if model is not None:
        from tickscope.plans.training import score_players

        scored = score_players(model, m.withColumns({f: F.col(f).cast("double") for f in FEATURES}), cfg)
    # read once for the players and three times for the matches
    judged = keep(judge(scored, cfg=cfg, model=model["meta"] if model else None).join(results.players(ticks), [*PLAYER], "left"), "judged")
    match = results.match_verdict(judged).join(results.match_span(ticks, cfg=cfg), "match_id")
    return Analysis(judged, match, combat_events(ticks, by_user, m, cfg=cfg, profile=profile, kin=kin, keep=keep, intervals=iv))


def analyse_matches(ticks: DataFrame, fires: DataFrame, *, cfg: AnalysisConfig = DEFAULT, profile="tabular",
                    radius: float | None = None, model: DataFrame | dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(player results, match results); ``model`` is a bundle, or metadata that only sets thresholds."""
    if isinstance(model, dict):
        return analyse(ticks, fires, cfg=cfg, profile=profile, radius=radius, model=model)[:2]
    m = player_metrics(ticks, fires, cfg=cfg, profile=profile, radius=radius)
    judged = judge(m, cfg=cfg, model=model).join(results.players(ticks), [*PLAYER], "left")
    return judged, results.match_verdict(judged).join(results.match_span(ticks, cfg=cfg), "match_id")


def analyse_to(path: str, ticks: DataFrame, fires: DataFrame, **options) -> None:
    """Write ``path``/players, /matches and /events; the intermediate tables are removed afterwards."""
    with WorkScope(ticks.sparkSession, "analysis") as work:
        for name, df in analyse(ticks, fires, keep=work.keep, **options)._asdict().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
