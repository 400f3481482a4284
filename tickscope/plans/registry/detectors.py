"""Queries of the five detectors over the telemetry view."""

from dataclasses import replace

from pyspark.sql import functions as F

from tickscope.config import DEFAULT as CFG
from tickscope.functions.numbers import stable_round
from tickscope.operators import aim, bhop, occlusion, spin, trigger
from tickscope.operators.blocks import PLAYER, exact_percentile
from tickscope.operators.timeline import kinematics, shot_ticks, timeline
from tickscope.plans import inputs as I
from tickscope.plans.registry import query
from tickscope.sources.workdir import materialize

RADIUS = 200.0


def kin(spark, sf):
    return kinematics(timeline(I.ticks(spark, sf)))


def aim_rows(spark, sf):
    t = I.ticks(spark, sf)
    return aim.aim_rows(t, I.fires(t))


def src(spark, sf):
    return aim.source_rows(aim_rows(spark, sf))


def r(c, n=6):
    return stable_round(c, n).alias(c)


def kin_sql(cols):
    return I.with_sql(I.KIN_SQL, f"SELECT match_id, steamid, tick, {cols} FROM kin")


def src_sql(cols):
    return I.with_sql(I.AIM_SQL, f"SELECT match_id, steamid, {cols} FROM m_aim")


# --- aim ---------------------------------------------------------------------------------------------------------

@query("AIM-1", kin_sql("CAST(gap AS BIGINT) AS gap, round(d_yaw, 6) AS d_yaw, round(d_pitch, 6) AS d_pitch"))
def aim1(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", "gap", r("d_yaw"), r("d_pitch"))


@query("AIM-2", kin_sql("round(speed, 6) AS speed"))
def aim2(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", r("speed"))


@query("AIM-3", kin_sql("round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk"))
def aim3(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", r("acceleration"), r("jerk"))


@query("AIM-4", kin_sql("direction_change"))
def aim4(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", "direction_change")


@query("AIM-5", I.with_sql(I.KIN_SQL, "SELECT match_id, steamid, tick FROM shot_ticks"))
def aim5(spark, sf):
    return shot_ticks(I.fires(I.ticks(spark, sf)))


@query("AIM-6", I.with_sql(I.SRC_SQL, "SELECT match_id, steamid, tick, src_i, src_n FROM src"))
def aim6(spark, sf):
    return src(spark, sf).select(*PLAYER, "tick", "src_i", "src_n")


@query("AIM-7", I.with_sql(I.SRC_SQL, """SELECT match_id, steamid, count(*) AS n,
  count(*) FILTER (isfinite(speed) AND isfinite(jerk) AND isfinite(yaw)) AS finite, round(sum(jerk), 3) AS jerk_sum
  FROM src GROUP BY 1, 2"""))
def aim7(spark, sf):
    ok = F.lit(True)
    for c in ("speed", "jerk", "yaw"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return src(spark, sf).groupBy(*PLAYER).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("finite"), stable_round(F.sum("jerk"), 3).alias("jerk_sum"))


AIM8 = ("aim_vitesse_max", "aim_p99", "aim_jerk_moyen", "aim_jerk_max", "aim_ratio_micro_ajustements", "aim_variance_vitesse")


@query("AIM-8", src_sql(", ".join(AIM8)))
def aim8(spark, sf):
    s = materialize(src(spark, sf), "aim_source")
    full = F.col("rows") >= CFG.aim_min_rows
    d = s.groupBy(*PLAYER).agg(*aim.basic_aggregates()).join(exact_percentile(s, "speed", 0.99, "aim_p99"), [*PLAYER])
    return d.select(*PLAYER, *[F.when(full, stable_round(c, 4)).otherwise(0.0).alias(c) for c in AIM8])


def shape(spark, sf, column):
    full = F.col("rows") >= CFG.aim_min_rows
    d = aim.path_shape(src(spark, sf)).groupBy(*PLAYER).agg(F.max("row_n").alias("rows"), *aim.shape_aggregates())
    return d.select(*PLAYER, F.when(full, stable_round(column, 4)).otherwise(0.0).alias(column))


@query("AIM-9", src_sql("aim_fov_lock_ratio"))
def aim9(spark, sf):
    return shape(spark, sf, "aim_fov_lock_ratio")


@query("AIM-10", src_sql("aim_fit_polynomial_indicatif"))
def aim10(spark, sf):
    return shape(spark, sf, "aim_fit_polynomial_indicatif")


@query("AIM-11", src_sql("aim_vitesse_acquisition"))
def aim11(spark, sf):
    return shape(spark, sf, "aim_vitesse_acquisition")


@query("AIM-12", I.with_sql(I.KIN_SQL, """SELECT match_id, steamid, 'aim_snap' AS type, tick, round(raw_speed, 2) AS snap_angle,
  round(raw_d_yaw, 2) AS delta_yaw, round(raw_d_pitch, 2) AS delta_pitch, round(raw_jerk, 2) AS jerk,
  coalesce(active_weapon_name, 'None') AS weapon FROM kin WHERE raw_speed > 18"""))
def aim12(spark, sf):
    return aim.snap_events(I.ticks(spark, sf)).drop("trajectory")


@query("AIM-13", I.with_sql(I.KIN_SQL, """, tr AS (
  SELECT *, string_agg(CAST(tick AS VARCHAR), ',') OVER w AS ticks_, sum(yaw) OVER w AS yaw_sum, sum(pitch) OVER w AS pitch_sum
  FROM kin WINDOW w AS (PARTITION BY match_id, steamid ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
  SELECT match_id, steamid, tick, ticks_ AS trajectory_ticks, round(yaw_sum, 4) AS yaw_sum, round(pitch_sum, 4) AS pitch_sum
  FROM tr WHERE raw_speed > 18"""))
def aim13(spark, sf):
    add = lambda f: stable_round(F.aggregate("trajectory", F.lit(0.0), lambda a, x: a + x[f]), 4)
    path = F.array_join(F.transform("trajectory", lambda x: x["tick"].cast("string")), ",")
    return aim.snap_events(I.ticks(spark, sf)).select(
        *PLAYER, "tick", path.alias("trajectory_ticks"), add("yaw").alias("yaw_sum"), add("pitch").alias("pitch_sum"))


# --- jumps -------------------------------------------------------------------------------------------------------

B = I.KIN_SQL + I.bhop_ctes(False)
B_REPLAY = I.KIN_SQL + I.bhop_ctes(True)


def jumps(spark, sf, profile="tabular"):
    return bhop.jump_rows(I.ticks(spark, sf), profile)


@query("BHP-1", I.with_sql(B, """SELECT match_id, steamid, tick, takeoff, landing, 'tabular' AS profile FROM jr WHERE takeoff OR landing
  UNION ALL SELECT match_id, steamid, tick, is_airborne AND row_i = 1 OR takeoff, landing AND row_i > 1, 'replay' FROM jr
  JOIN (SELECT match_id, steamid, tick, is_airborne FROM kin) USING (match_id, steamid, tick)
  WHERE (is_airborne AND row_i = 1) OR takeoff OR landing"""))
def bhp1(spark, sf):
    d = None
    for p in ("tabular", "replay"):
        x = jumps(spark, sf, p).where("takeoff or landing").select(*PLAYER, "tick", "takeoff", "landing", F.lit(p).alias("profile"))
        d = x if d is None else d.unionByName(x)
    return d


@query("BHP-2", I.with_sql(B, "SELECT match_id, steamid, landing_tick, takeoff_tick, ground_ticks FROM iv"))
def bhp2(spark, sf):
    return bhop.ground_intervals(jumps(spark, sf)).select(*PLAYER, "landing_tick", "takeoff_tick", "ground_ticks")


@query("BHP-3", I.with_sql(B, "SELECT match_id, steamid, bhop_ratio_parfaits FROM m_bhop"))
def bhp3(spark, sf):
    return bhop.bhop_metrics_of(jumps(spark, sf), keep=materialize).select(*PLAYER, "bhop_ratio_parfaits")


@query("BHP-4", I.with_sql(B, "SELECT match_id, steamid, bhop_chaine_max FROM m_bhop"))
def bhp4(spark, sf):
    return bhop.bhop_metrics_of(jumps(spark, sf), keep=materialize).select(*PLAYER, "bhop_chaine_max")


@query("BHP-5", I.with_sql(B, """SELECT match_id, steamid, 'bhop_chain' AS type, start_tick, end_tick, run_len AS chain_length,
  round(bhop_vitesse_moyenne, 2) AS avg_speed FROM runs JOIN m_bhop USING (match_id, steamid)
  WHERE run_len >= 4 AND bhop_chaine_max >= 4"""))
def bhp5(spark, sf):
    return bhop.chain_events_of(jumps(spark, sf), keep=materialize)


@query("BHP-6", I.with_sql(B, "SELECT match_id, steamid, bhop_variance_sol FROM m_bhop"))
def bhp6(spark, sf):
    return bhop.bhop_metrics_of(jumps(spark, sf), keep=materialize).select(*PLAYER, "bhop_variance_sol")


@query("BHP-7", I.with_sql(B, """SELECT match_id, steamid, round(avg(speed_2d), 4) AS mean_speed,
  round(sqrt(avg(velocity_X * velocity_X + velocity_Y * velocity_Y)), 4) AS rms_speed FROM jr GROUP BY 1, 2"""))
def bhp7(spark, sf):
    d = jumps(spark, sf)
    return d.groupBy(*PLAYER).agg(
        stable_round(F.avg("speed_2d"), 4).alias("mean_speed"),
        stable_round(F.sqrt(F.avg(F.col("velocity_X") * F.col("velocity_X") + F.col("velocity_Y") * F.col("velocity_Y"))), 4).alias("rms_speed"))


@query("BHP-8", I.with_sql(B_REPLAY, "SELECT match_id, steamid, round(strafe, 4) AS strafe FROM strafe"))
def bhp8(spark, sf):
    return bhop.air_strafe(jumps(spark, sf, "replay")).select(*PLAYER, r("strafe", 4))


@query("BHP-9", I.with_sql(B_REPLAY, "SELECT match_id, steamid, round(gain, 4) AS gain FROM strafe"))
def bhp9(spark, sf):
    return bhop.air_strafe(jumps(spark, sf, "replay")).select(*PLAYER, r("gain", 4))


BHOP = ", ".join(bhop.METRICS)


@query("BHP-10", f"""SELECT * FROM (WITH {B} SELECT match_id, steamid, 'tabular' AS profile, {BHOP} FROM m_bhop)
  UNION ALL SELECT * FROM (WITH {B_REPLAY} SELECT match_id, steamid, 'replay' AS profile, {BHOP} FROM m_bhop)""")
def bhp10(spark, sf):
    return bhop.bhop_metrics_both(I.ticks(spark, sf), keep=materialize)


# --- spin --------------------------------------------------------------------------------------------------------

S = I.KIN_SQL + I.SPIN_CTES


def spin_sql(cols):
    return I.with_sql(S, f"SELECT match_id, steamid, {cols} FROM m_spin")


@query("SPN-1", I.with_sql(S, "SELECT match_id, steamid, tick, round(spin_mean, 4) AS spin_mean FROM sp0"))
def spn1(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", r("spin_mean", 4))


@query("SPN-2", I.with_sql(S, "SELECT match_id, steamid, count(*) FILTER (spin_mean > 90) AS windows FROM sp0 GROUP BY 1, 2"))
def spn2(spark, sf):
    return kin(spark, sf).groupBy(*PLAYER).agg(F.count_if(F.col("spin_mean") > CFG.spin_speed).alias("windows"))


@query("SPN-3", I.with_sql(S, "SELECT match_id, steamid, count(*) FILTER (abs(pitch) > 89.5) AS violations FROM sp0 GROUP BY 1, 2"))
def spn3(spark, sf):
    return kin(spark, sf).groupBy(*PLAYER).agg(F.count_if(F.abs("pitch") > CFG.pitch_limit).alias("violations"))


@query("SPN-4", I.with_sql(S, "SELECT match_id, steamid, tick, round(pitch_var, 4) AS pitch_var FROM sp0"))
def spn4(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", r("pitch_var", 4))


@query("SPN-5", I.with_sql(S, "SELECT match_id, steamid, tick, CAST(pitch_turns AS BIGINT) AS pitch_turns FROM sp0"))
def spn5(spark, sf):
    return kin(spark, sf).select(*PLAYER, "tick", "pitch_turns")


@query("SPN-6", I.with_sql(S, "SELECT match_id, steamid, flips FROM flips"))
def spn6(spark, sf):
    return spin.flip_runs(kin(spark, sf)).groupBy(*PLAYER).agg(F.max("run_len").alias("flips"))


@query("SPN-7", spin_sql(", ".join(spin.METRICS)) + """ WHERE spinbot_yaw_spin_windows > 0 OR spinbot_pitch_violations > 0
  OR spinbot_jitter_score > 2000 OR spinbot_desync_max_ticks >= 6""")
def spn7(spark, sf):
    return spin.spin_events(spin.spin_metrics_of(materialize(kin(spark, sf).drop("around"), "kinematics"))).select(*PLAYER, "metrics.*")


# --- occlusion ---------------------------------------------------------------------------------------------------

O = I.BASE_SQL + I.occ_ctes()
O_REPLAY = I.KIN_SQL + I.occ_ctes(replay=True)
O_PARITY = I.BASE_SQL + I.occ_ctes(alive=False, first_team=True)


def pairs(spark, sf, **kw):
    return occlusion.sight_pairs(I.ticks(spark, sf), **kw)


@query("OCC-1", I.with_sql(O, """SELECT match_id, tick, steamid, target, round(distance, 4) AS distance, round(error, 4) AS error
  FROM pairs WHERE abs(dx) <= 2000 AND abs(dy) <= 2000 AND distance_2d BETWEEN 200 AND 2000"""))
def occ1(spark, sf):
    return pairs(spark, sf, occluded=False).select("match_id", "tick", "steamid", "target", r("distance", 4), r("error", 4))


@query("OCC-2", I.with_sql(O, """SELECT match_id, steamid, count(*) AS hidden_rows, count(DISTINCT target) AS hidden_targets
  FROM pairs WHERE NOT spotted GROUP BY 1, 2"""))
def occ2(spark, sf):
    return pairs(spark, sf, in_range=False).groupBy(*PLAYER).agg(
        F.count(F.lit(1)).alias("hidden_rows"), F.count_distinct("target").alias("hidden_targets"))


@query("OCC-3", I.with_sql(O, """SELECT 'tabular' AS profile, match_id, steamid, tick, target, round(distance_2d, 4) AS distance_2d,
  round(distance, 4) AS distance FROM pairs WHERE NOT spotted AND distance_2d BETWEEN 200 AND 2000 UNION ALL
  SELECT 'replay', match_id, steamid, tick, target, round(distance_2d, 4), round(distance, 4) FROM pairs
  WHERE NOT spotted AND distance BETWEEN 200 AND 2000"""))
def occ3(spark, sf):
    cols = (*PLAYER, "tick", "target", r("distance_2d", 4), r("distance", 4))
    a = pairs(spark, sf).select(F.lit("tabular").alias("profile"), *cols)
    return a.unionByName(pairs(spark, sf, profile="replay").select(F.lit("replay").alias("profile"), *cols))


def occ(spark, sf, **kw):
    return occlusion.occlusion_metrics(I.ticks(spark, sf), keep=materialize, **kw)


def occ_sql(cols, ctes=O):
    return I.with_sql(ctes, f"SELECT match_id, steamid, {cols} FROM m_occ")


@query("OCC-4", occ_sql("wh_ratio_lock_cache, wh_ratio_lock_strict"))
def occ4(spark, sf):
    return occ(spark, sf).select(*PLAYER, "wh_ratio_lock_cache", "wh_ratio_lock_strict")


@query("OCC-5", occ_sql("wh_preaim_score", O_REPLAY))
def occ5(spark, sf):
    return occ(spark, sf, profile="replay").select(*PLAYER, "wh_preaim_score")


@query("OCC-6", occ_sql("wh_info_timing_ratio", O_REPLAY))
def occ6(spark, sf):
    return occ(spark, sf, profile="replay").select(*PLAYER, "wh_info_timing_ratio")


# random views hold a 2.5 degree lock for one tick only; runs are checked with a wide lock
LOOSE = replace(CFG, strict_angle=60.0, lock_event_ratio=0.01, lock_event_run=2)


def loosen(ctes):
    return ctes.replace("error < 2.5", "error < 60")


@query("OCC-7", I.with_sql(loosen(O_REPLAY), "SELECT match_id, steamid, run FROM active_runs"))
def occ7(spark, sf):
    return occlusion.active_runs(pairs(spark, sf, profile="replay"), LOOSE).groupBy(*PLAYER).agg(F.max("run_len").alias("run"))


@query("OCC-8", I.with_sql(loosen(O), "SELECT match_id, steamid, run FROM strict_runs"))
def occ8(spark, sf):
    return occlusion.strict_runs(pairs(spark, sf), LOOSE).groupBy(*PLAYER).agg(F.max("run_len").alias("run"))


@query("OCC-9", occ_sql("wh_distance_moyenne_verrous"))
def occ9(spark, sf):
    return occ(spark, sf).select(*PLAYER, "wh_distance_moyenne_verrous")


@query("OCC-10", I.with_sql(loosen(O), """, flagged AS (SELECT * FROM m_occ WHERE wh_ratio_lock_strict > 0.01 OR wh_tracking_consecutif_max >= 2),
  span AS (SELECT match_id, steamid, min(tick) AS start_tick, max(tick) AS end_tick FROM pairs WHERE NOT spotted GROUP BY 1, 2),
  sides AS (SELECT match_id, team_num, min((tick, steamid, name)) AS f FROM occ_base GROUP BY 1, 2),
  fe AS (SELECT p.match_id, p.steamid, min(f) AS f FROM (SELECT DISTINCT match_id, steamid, first_team FROM occ_base) p JOIN sides s
    ON p.match_id = s.match_id AND p.first_team <> s.team_num GROUP BY 1, 2)
  SELECT match_id, steamid, 'wh_lock' AS type, start_tick, end_tick, CAST(wh_tracking_consecutif_max AS BIGINT) AS duration_ticks,
         f[3] AS target_name, f[2] AS target_steamid, round(wh_distance_moyenne_verrous, 2) AS distance
  FROM flagged JOIN span USING (match_id, steamid) LEFT JOIN fe USING (match_id, steamid)"""))
def occ10(spark, sf):
    return occlusion.lock_events(I.ticks(spark, sf), occ(spark, sf, cfg=LOOSE), cfg=LOOSE)


OCC = ", ".join(occlusion.METRICS)


@query("OCC-11", f"""SELECT * FROM (WITH {O_REPLAY} SELECT match_id, steamid, 'replay' AS profile, {OCC} FROM m_occ)
  UNION ALL SELECT * FROM (WITH {O_PARITY} SELECT match_id, steamid, 'tabular_parity' AS profile, {OCC} FROM m_occ)""")
def occ11(spark, sf):
    a = occ(spark, sf, profile="replay").withColumn("profile", F.lit("replay"))
    b = occ(spark, sf, alive_only=False, team_mode="first").withColumn("profile", F.lit("tabular_parity"))
    return a.unionByName(b)


# --- trigger -----------------------------------------------------------------------------------------------------

TR = I.BASE_SQL + I.trigger_ctes(RADIUS)


def shots(spark, sf):
    t = I.ticks(spark, sf)
    return t, I.fires(t).select("match_id", F.col("user_steamid").alias("steamid"), "tick").distinct()


def targets(spark, sf):
    t, s = shots(spark, sf)
    return t, trigger.shot_targets(t, s, radius=RADIUS, keep=materialize)


def reactions(spark, sf):
    t, h = targets(spark, sf)
    return t, trigger.reaction_times(t, h, radius=RADIUS)


@query("TRG-1", I.with_sql(I.BASE_SQL, """, s AS (
  SELECT match_id, user_steamid AS steamid, tick, 0 AS rank FROM fires WHERE CAST(substr(weapon, 2) AS INT) < 3 UNION ALL
  SELECT match_id, steamid, tick, 1 FROM ticks WHERE active_weapon_name = 'click')
  SELECT DISTINCT match_id, steamid, tick FROM s JOIN (SELECT match_id, steamid, min(rank) AS rank FROM s GROUP BY 1, 2)
  USING (match_id, steamid, rank)"""))
def trg1(spark, sf):
    t = I.ticks(spark, sf)
    first = I.fires(t).where("cast(substring(weapon, 2) as int) < 3").select(
        "match_id", F.col("user_steamid").alias("steamid"), "tick")
    return trigger.shots_of(first, t.where("active_weapon_name = 'click'"))


@query("TRG-2", I.with_sql(I.BASE_SQL, """, f AS (SELECT match_id, steamid, tick, tick - lag(tick) OVER w AS gap,
  row_number() OVER w AS n FROM ticks WHERE active_weapon_name IN ('purchase', 'click', 'view')
  WINDOW w AS (PARTITION BY match_id, steamid ORDER BY tick)), l AS (SELECT match_id, steamid, count(*) FILTER (gap > 1) AS later FROM f GROUP BY 1, 2)
  SELECT match_id, steamid, tick FROM f JOIN l USING (match_id, steamid) WHERE gap > 1 OR (later = 0 AND n = 1)"""))
def trg2(spark, sf):
    t = I.ticks(spark, sf).withColumn("is_firing", F.col("active_weapon_name").isin("purchase", "click", "view"))
    return trigger.burst_starts(t)


@query("TRG-3", I.with_sql(TR, "SELECT match_id, steamid, shot_tick AS tick, target FROM hits"))
def trg3(spark, sf):
    return targets(spark, sf)[1]


@query("TRG-4", I.with_sql(TR, "SELECT match_id, steamid, shot_tick, target, ticks_aligned, round(reaction_ms, 4) AS reaction_ms FROM reactions"))
def trg4(spark, sf):
    return reactions(spark, sf)[1].select(*PLAYER, "shot_tick", "target", F.col("ticks_aligned").cast("long").alias("ticks_aligned"),
                                          r("reaction_ms", 4))


TRIG = ", ".join(trigger.METRICS)


@query("TRG-5", I.with_sql(TR, f"SELECT match_id, steamid, {TRIG} FROM m_trig"))
def trg5(spark, sf):
    t, s = shots(spark, sf)
    return trigger.trigger_metrics(t, s, radius=RADIUS, keep=materialize)


@query("TRG-6", I.with_sql(TR, "SELECT match_id, steamid, bursts FROM bursts"))
def trg6(spark, sf):
    return trigger.fast_bursts(materialize(reactions(spark, sf)[1], "reactions"))


@query("TRG-7", I.with_sql(TR, """SELECT match_id, steamid, 'Anomalously fast median reaction time' AS reason, triggerbot_rt_median AS value FROM m_trig
  WHERE triggerbot_total_shots_analyzed > 0 AND triggerbot_rt_median < 50 UNION ALL
  SELECT match_id, steamid, 'Statistically improbable consistency (std dev)', triggerbot_rt_std FROM m_trig
  WHERE triggerbot_total_shots_analyzed >= 3 AND triggerbot_rt_std < 15 UNION ALL
  SELECT match_id, steamid, 'Sub-tick burst reaction pattern detected', CAST(triggerbot_burst_count AS DOUBLE) FROM m_trig
  WHERE triggerbot_total_shots_analyzed > 0 AND triggerbot_burst_count > 0"""))
def trg7(spark, sf):
    t, s = shots(spark, sf)
    return trigger.trigger_flags(trigger.trigger_metrics(t, s, radius=RADIUS, keep=materialize))
