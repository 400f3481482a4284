"""Telemetry view over the ``events`` table: the same definition for Spark and, as text, for SQL.

A user is a player, ten users are a match, an event is a tick row. Ticks are a running sum with gaps.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.operators.blocks import block_index
from tickscope.sources.workdir import new_path, store

EVENT_BLOCK = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

_STORED: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Like ``stored`` for any format: ``write(path)`` runs once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = new_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table derived from ``sf_dir``, written once per application, as an installation would keep it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = store(build(), name)
    return spark.read.parquet(_STORED[key])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "ticks", lambda: derive_ticks(spark, sf_dir))


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinematics with shot marks, shared by the metrics, the timeline and the report events."""
    from tickscope.plans.analyze import kinematic_rows

    def build():
        t = ticks(spark, sf_dir)
        return kinematic_rows(t, fires(t))

    return stored(spark, sf_dir, "kinematics", build)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all detectors with a head sphere of 200 units, so that the random view hits something."""
    from tickscope.plans.analyze import player_metrics

    def build():
        t = ticks(spark, sf_dir)
        return player_metrics(t, fires(t), radius=200.0, kin=kinematics(spark, sf_dir)).join(
            t.groupBy("match_id", "steamid").agg(F.min("name").alias("name"), F.min("team_num").alias("team_number"),
                                                 (F.sum("event_id") % 1000 / 10.0).alias("ml_score")),
            ["match_id", "steamid"])

    return stored(spark, sf_dir, "metrics", build)


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _STORED


def feature_metrics(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, name: str = "feature_metrics") -> DataFrame:
    """Metrics of the detectors that features come from, of the players ``of`` or of all. Written metrics and kinematics are used if they are at hand."""
    from tickscope.plans.analyze import player_metrics

    def build():
        t = ticks(spark, sf_dir)
        kin = kinematics(spark, sf_dir) if is_stored(spark, sf_dir, "kinematics") else None
        return player_metrics(t, fires(t), radius=200.0, kin=kin, detectors=("aim", "bhop", "occlusion"), of=of)

    return metrics(spark, sf_dir) if is_stored(spark, sf_dir, "metrics") else stored(spark, sf_dir, name, build)


def scaled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random views trip every aim rule; scaled down, each rule holds for some players and not for others."""
    m = metrics(spark, sf_dir)
    return m.withColumns({c: F.expr(e) for c, e in SCALED.items()})


SCALED = {
    "aim_vitesse_max": "aim_vitesse_max * 0.1D", "aim_p99": "aim_p99 * 0.1D", "aim_jerk_max": "aim_jerk_max * 0.25D",
    "bhop_total_sauts": "bhop_total_sauts", "bhop_ratio_parfaits": "bhop_ratio_parfaits * 1.3D",
    "wh_ratio_lock_strict": "wh_ratio_lock_strict * 8.0D", "wh_ratio_lock_cache": "wh_ratio_lock_cache * 8.0D",
    "wh_tracking_consecutif_max": "wh_tracking_consecutif_max * (100 + 2 * aim_jerk_moyen)",
    "spinbot_yaw_speed_max": "spinbot_yaw_speed_max * 0.9D",
    "spinbot_yaw_spin_windows": "greatest(spinbot_yaw_spin_windows - 20, 0)",
    "spinbot_pitch_violations": "greatest(spinbot_pitch_violations - 2, 0)",
    "spinbot_jitter_score": "spinbot_jitter_score * 0.9D",
    "spinbot_desync_max_ticks": "spinbot_desync_max_ticks * 3",
}


def derive_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id is unique, so a block of event ids bounds the rows of one player in it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    step = F.when(F.col("event_type") == "error", 2).otherwise(1)
    d = block_index(e, {"t": step}, ("user_id",), ("event_id",), EVENT_BLOCK)
    eid, v = F.col("event_id"), F.col("value")
    return d.select(
        "event_id",
        F.concat(F.lit("m"), F.expr("cast(user_id div 10 as string)")).alias("match_id"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("Player_"), F.col("user_id").cast("string")))
        .otherwise((F.col("user_id") + F.lit(76561190000000000)).cast("string")).alias("steamid"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"),
        F.col("t_i").alias("tick"),
        ((eid * 37) % 3000).cast("double").alias("X"), ((eid * 91) % 3000).cast("double").alias("Y"),
        ((eid * 13) % 128).cast("double").alias("Z"),
        F.when(eid % 50 == 0, 120.0).otherwise(F.pmod(v * 3.0, F.lit(20.0)) - 10.0).alias("pitch"),
        (F.pmod(v * 7.0, F.lit(360.0)) - 180.0).alias("yaw"),
        (F.lit(2) + F.col("user_id") % 2).cast("int").alias("team_num"),
        F.when(eid % 11 == 0, 0).otherwise(100).alias("health"),
        (eid % 3 == 0).alias("spotted"),
        F.col("event_type").isin("click", "view").alias("is_airborne"),
        (v - 50.0).alias("velocity_X"), ((eid % 100) - 50).cast("double").alias("velocity_Y"),
        F.col("event_type").alias("active_weapon_name"),
    )


def fires(t: DataFrame) -> DataFrame:
    return t.where("active_weapon_name = 'purchase'").select(
        "match_id", "tick", F.col("steamid").alias("user_steamid"), F.col("name").alias("user_name"),
        F.concat(F.lit("w"), (F.col("event_id") % 7).cast("string")).alias("weapon"))


BASE_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)
              OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS tick
  FROM events),
ticks AS (
  SELECT event_id, 'm' || CAST(user_id // 10 AS VARCHAR) AS match_id,
         CASE WHEN user_id % 5 = 0 THEN 'Player_' || CAST(user_id AS VARCHAR)
              ELSE CAST(user_id + 76561190000000000 AS VARCHAR) END AS steamid,
         'p' || CAST(user_id AS VARCHAR) AS name, tick,
         CAST((event_id * 37) % 3000 AS DOUBLE) AS X, CAST((event_id * 91) % 3000 AS DOUBLE) AS Y,
         CAST((event_id * 13) % 128 AS DOUBLE) AS Z,
         CASE WHEN event_id % 50 = 0 THEN 120.0::DOUBLE ELSE fmod(value * 3.0::DOUBLE, 20.0::DOUBLE) - 10.0::DOUBLE END AS pitch,
         fmod(value * 7.0::DOUBLE, 360.0::DOUBLE) - 180.0::DOUBLE AS yaw,
         CAST(2 + user_id % 2 AS INTEGER) AS team_num,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE 100 END AS health,
         event_id % 3 = 0 AS spotted, event_type IN ('click', 'view') AS is_airborne,
         value - 50.0::DOUBLE AS velocity_X, CAST((event_id % 100) - 50 AS DOUBLE) AS velocity_Y,
         event_type AS active_weapon_name
  FROM ev),
fires AS (
  SELECT match_id, tick, steamid AS user_steamid, name AS user_name, 'w' || CAST(event_id % 7 AS VARCHAR) AS weapon
  FROM ticks WHERE active_weapon_name = 'purchase')
"""


def wrap_sql(x: str) -> str:
    """pmod(x + 180, 360) - 180 in SQL, bit for bit."""
    f = f"fmod(({x}) + 180.0::DOUBLE, 360.0::DOUBLE)"
    return f"(CASE WHEN {f} < 0 THEN fmod({f} + 360.0::DOUBLE, 360.0::DOUBLE) ELSE {f} END - 180.0::DOUBLE)"


_P = "PARTITION BY match_id, steamid ORDER BY tick"

KIN_SQL = BASE_SQL + f""",
shot_ticks AS (
  SELECT DISTINCT match_id, user_steamid AS steamid, tick + o AS tick
  FROM fires, (SELECT unnest(generate_series(-5, 10)) AS o)),
live AS (
  SELECT t.*, s.tick IS NOT NULL AS in_shot,
         row_number() OVER (PARTITION BY t.match_id, t.steamid ORDER BY t.tick) AS row_i,
         count(*) OVER (PARTITION BY t.match_id, t.steamid) AS row_n
  FROM ticks t LEFT JOIN shot_ticks s USING (match_id, steamid, tick)
  WHERE health > 0),
k0 AS (
  SELECT *, tick - lag(tick) OVER ({_P}) AS gap, lag(yaw) OVER ({_P}) AS yaw_before,
         lag(pitch) OVER ({_P}) AS pitch_before
  FROM live),
k1 AS (
  SELECT *, CASE WHEN gap = 1 THEN {wrap_sql('yaw - yaw_before')} ELSE 0 END AS d_yaw,
         CASE WHEN gap = 1 THEN pitch - pitch_before ELSE 0 END AS d_pitch,
         abs({wrap_sql('yaw - yaw_before')}) AS raw_d_yaw, abs(pitch - pitch_before) AS raw_d_pitch,
         abs(yaw - yaw_before) AS yaw_step
  FROM k0),
k2 AS (
  SELECT *, sqrt(d_yaw * d_yaw + d_pitch * d_pitch) AS speed,
         sqrt(raw_d_yaw * raw_d_yaw + raw_d_pitch * raw_d_pitch) AS raw_speed,
         sign(d_yaw) AS yaw_sign, sign(d_pitch) AS pitch_sign
  FROM k1),
k3 AS (
  SELECT *, CASE WHEN gap = 1 THEN abs(speed - lag(speed) OVER ({_P})) ELSE 0 END AS acceleration,
         coalesce(abs(raw_speed - lag(raw_speed) OVER ({_P})), 0) AS raw_jerk,
         coalesce(yaw_sign <> lag(yaw_sign) OVER ({_P}), TRUE) AND abs(d_yaw) > 0.05
           AND coalesce(gap = 1, FALSE) AS direction_change,
         coalesce(yaw_sign <> lag(yaw_sign) OVER ({_P}), TRUE) AND abs(d_yaw) > 140
           AND coalesce(gap = 1, FALSE) AS yaw_flip,
         coalesce(pitch_sign <> lag(pitch_sign) OVER ({_P}), TRUE) AND coalesce(gap = 1, FALSE) AS pitch_turn
  FROM k2),
kin AS (
  SELECT *, CASE WHEN gap = 1 THEN abs(acceleration - lag(acceleration) OVER ({_P})) ELSE 0 END AS jerk
  FROM k3)
"""

SRC_SQL = KIN_SQL + """,
shot_n AS (SELECT match_id, steamid, count(*) FILTER (in_shot) > 10 AS use_shot FROM kin GROUP BY 1, 2),
src AS (
  SELECT kin.*, use_shot, row_number() OVER (PARTITION BY match_id, steamid ORDER BY tick) AS src_i,
         count(*) OVER (PARTITION BY match_id, steamid) AS src_n
  FROM kin JOIN shot_n USING (match_id, steamid) WHERE in_shot OR NOT use_shot)
"""


AIM_SQL = SRC_SQL + """,
shape0 AS (
  SELECT *, (src_i - 1) % 8 AS pos,
         avg(speed) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS next5
  FROM src WINDOW w AS (PARTITION BY match_id, steamid ORDER BY src_i)),
blocks8 AS (
  SELECT match_id, steamid, (src_i - 1) // 8 AS b, max(src_n) AS n,
         sum((CASE pos WHEN 0 THEN -7 WHEN 1 THEN -5 WHEN 2 THEN -3 WHEN 3 THEN -1 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 5 ELSE 7 END) * yaw) AS c1,
         sum((CASE pos WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN -3 WHEN 3 THEN -5 WHEN 4 THEN -5 WHEN 5 THEN -3 WHEN 6 THEN 1 ELSE 7 END) * yaw) AS c2,
         var_pop(yaw) * 8 AS ss, max(yaw) - min(yaw) AS rng, count(*) AS c
  FROM shape0 GROUP BY 1, 2, 3),
fit AS (
  SELECT match_id, steamid, avg(greatest(0, (c1 * c1 + c2 * c2) / 168 / ss)) AS r2
  FROM blocks8 WHERE b * 8 < n - 8 AND n >= 10 AND rng > 2 AND ss > 1e-6 GROUP BY 1, 2),
m_aim0 AS (
  SELECT match_id, steamid, max(row_n) AS rows_, max(speed) AS a1, quantile_cont(speed, 0.99) AS a2, avg(jerk) AS a3,
         max(jerk) AS a4, avg(direction_change::INT) * 100 AS a5, coalesce(var_samp(speed), 0) AS a6,
         coalesce(count(*) FILTER (speed > 5 AND src_i <= src_n - 5 AND next5 < 0.3)
                  / nullif(count(*) FILTER (speed > 5 AND src_i <= src_n - 5), 0), 0) AS a7,
         coalesce(avg(speed) FILTER (speed > 3 AND src_i <= src_n - 3), 0) AS a9
  FROM shape0 GROUP BY 1, 2),
m_aim AS (
  SELECT match_id, steamid,
         CASE WHEN rows_ >= 20 THEN round(a1, 4) ELSE 0 END AS aim_vitesse_max,
         CASE WHEN rows_ >= 20 THEN round(a2, 4) ELSE 0 END AS aim_p99,
         CASE WHEN rows_ >= 20 THEN round(a3, 4) ELSE 0 END AS aim_jerk_moyen,
         CASE WHEN rows_ >= 20 THEN round(a4, 4) ELSE 0 END AS aim_jerk_max,
         CASE WHEN rows_ >= 20 THEN round(a5, 4) ELSE 0 END AS aim_ratio_micro_ajustements,
         CASE WHEN rows_ >= 20 THEN round(a6, 4) ELSE 0 END AS aim_variance_vitesse,
         CASE WHEN rows_ >= 20 THEN round(a7, 4) ELSE 0 END AS aim_fov_lock_ratio,
         CASE WHEN rows_ >= 20 THEN round(coalesce(r2, 0), 4) ELSE 0 END AS aim_fit_polynomial_indicatif,
         CASE WHEN rows_ >= 20 THEN round(a9, 4) ELSE 0 END AS aim_vitesse_acquisition
  FROM m_aim0 LEFT JOIN fit USING (match_id, steamid))
"""


def bhop_ctes(replay: bool) -> str:
    """Jump CTEs on top of ``kin``."""
    first = "FALSE" if replay else "is_airborne"
    speed = ("avg(sqrt(velocity_X * velocity_X + velocity_Y * velocity_Y))" if replay
             else "sqrt(avg(velocity_X * velocity_X + velocity_Y * velocity_Y))")
    min_rows, min_jumps = (50, 3) if replay else (5, 2)
    jumps = "jumps" if replay else "CASE WHEN air_rows = 0 OR air_rows = rows_ THEN 0 ELSE jumps END"
    return f""",
jr0 AS (
  SELECT match_id, steamid, tick, row_i, row_n, yaw, velocity_X, velocity_Y, is_airborne AS air,
         coalesce(lag(is_airborne) OVER ({_P}), {first}) AS before_,
         sqrt(velocity_X * velocity_X + velocity_Y * velocity_Y) AS speed_2d
  FROM kin),
jr AS (SELECT *, air AND NOT before_ AS takeoff, NOT air AND before_ AS landing FROM jr0),
steps AS (SELECT *, lead(tick) OVER ({_P}) AS nxt FROM jr WHERE takeoff OR landing),
iv AS (
  SELECT match_id, steamid, tick AS landing_tick, nxt AS takeoff_tick, nxt - tick AS ground_ticks, nxt - tick <= 1 AS perfect
  FROM steps WHERE landing AND nxt IS NOT NULL),
iv2 AS (
  SELECT *, sum((NOT perfect)::INT) OVER (PARTITION BY match_id, steamid ORDER BY landing_tick) AS island FROM iv),
runs AS (
  SELECT match_id, steamid, min(landing_tick) AS start_tick, max(takeoff_tick) AS end_tick, count(*) AS run_len
  FROM iv2 WHERE perfect GROUP BY match_id, steamid, island),
air0 AS (
  SELECT *, degrees(atan2(velocity_Y, velocity_X)) AS heading FROM jr WHERE air),
air1 AS (
  SELECT *, yaw - lag(yaw) OVER ({_P}) AS turn, heading - lag(heading) OVER ({_P}) AS drift,
         speed_2d - lag(speed_2d) OVER ({_P}) AS gain FROM air0),
strafe AS (
  SELECT match_id, steamid, CASE WHEN count(*) > 20 AND count(turn) > 10
           THEN coalesce(covar_pop(turn, drift) / nullif(stddev_pop(turn) * stddev_pop(drift), 0), 0) ELSE 0 END AS strafe,
         CASE WHEN count(*) > 20 THEN coalesce(max(gain), 0) ELSE 0 END AS gain
  FROM air1 GROUP BY 1, 2),
m_bhop0 AS (
  SELECT match_id, steamid, max(row_n) AS rows_, count(*) FILTER (takeoff) AS jumps, count(*) FILTER (air) AS air_rows,
         {speed} AS mean_speed FROM jr GROUP BY 1, 2),
ivs AS (SELECT match_id, steamid, avg(perfect::INT) AS ratio, var_pop(ground_ticks) AS ground_var FROM iv GROUP BY 1, 2),
chains AS (SELECT match_id, steamid, max(run_len) AS chain FROM runs GROUP BY 1, 2),
m_bhop1 AS (
  SELECT *, {jumps} AS j FROM m_bhop0 LEFT JOIN ivs USING (match_id, steamid) LEFT JOIN chains USING (match_id, steamid)
  LEFT JOIN strafe USING (match_id, steamid)),
m_bhop AS (
  SELECT match_id, steamid,
         CAST(CASE WHEN rows_ >= {min_rows} THEN j ELSE 0 END AS DOUBLE) AS bhop_total_sauts,
         round(CASE WHEN rows_ >= {min_rows} AND j >= {min_jumps} THEN coalesce(ratio, 0) ELSE 0 END, 4) AS bhop_ratio_parfaits,
         round(CASE WHEN rows_ >= {min_rows} AND j >= {min_jumps} THEN coalesce(ground_var, 50) ELSE 50 END, 4) AS bhop_variance_sol,
         CAST(CASE WHEN rows_ >= {min_rows} AND j >= {min_jumps} THEN coalesce(chain, 0) ELSE 0 END AS DOUBLE) AS bhop_chaine_max,
         round(CASE WHEN rows_ >= {min_rows} THEN mean_speed ELSE 0 END, 4) AS bhop_vitesse_moyenne,
         round(CASE WHEN {str(replay).upper()} AND rows_ >= {min_rows} AND j >= {min_jumps} THEN coalesce(strafe, 0) ELSE 0 END, 4) AS bhop_autostrafe_correlation,
         round(CASE WHEN {str(replay).upper()} AND rows_ >= {min_rows} AND j >= {min_jumps} THEN coalesce(gain, 0) ELSE 0 END, 4) AS bhop_velocity_gain_max
  FROM m_bhop1)
"""


SPIN_CTES = f""",
sp0 AS (
  SELECT *, CASE WHEN row_i >= 16 THEN avg(abs(d_yaw)) OVER ({_P} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) END AS spin_mean,
         CASE WHEN row_i >= 8 THEN var_samp(pitch) OVER ({_P} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS pitch_var,
         CASE WHEN row_i >= 8 THEN sum(pitch_turn::INT) OVER ({_P} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS pitch_turns,
         row_i - row_number() OVER (PARTITION BY match_id, steamid, yaw_flip ORDER BY tick) AS island
  FROM kin),
flips AS (
  SELECT match_id, steamid, max(c) AS flips FROM (
    SELECT match_id, steamid, count(*) AS c FROM sp0 WHERE yaw_flip GROUP BY match_id, steamid, island) GROUP BY 1, 2),
m_spin0 AS (
  SELECT match_id, steamid, max(row_n) AS rows_, coalesce(max(spin_mean), 0) AS s1, count(*) FILTER (spin_mean > 90) AS s5,
         count(*) FILTER (abs(pitch) > 89.5) AS s2, coalesce(max(pitch_var), 0) AS s3, coalesce(max(pitch_turns), 0) AS s6
  FROM sp0 GROUP BY 1, 2),
m_spin AS (
  SELECT match_id, steamid, CASE WHEN rows_ >= 32 THEN round(s1, 4) ELSE 0 END AS spinbot_yaw_speed_max,
         CAST(CASE WHEN rows_ >= 32 THEN s2 ELSE 0 END AS BIGINT) AS spinbot_pitch_violations,
         CASE WHEN rows_ >= 32 THEN round(s3, 4) ELSE 0 END AS spinbot_jitter_score,
         CAST(CASE WHEN rows_ >= 32 THEN coalesce(flips, 0) ELSE 0 END AS BIGINT) AS spinbot_desync_max_ticks,
         CAST(CASE WHEN rows_ >= 32 THEN s5 ELSE 0 END AS BIGINT) AS spinbot_yaw_spin_windows,
         CAST(CASE WHEN rows_ >= 32 THEN s6 ELSE 0 END AS BIGINT) AS spinbot_pitch_turns_max
  FROM m_spin0 LEFT JOIN flips USING (match_id, steamid))
"""


def occ_ctes(replay: bool = False, alive: bool = True, first_team: bool = False) -> str:
    """Occlusion CTEs on top of ``ticks`` (and ``kin`` for the replay profile)."""
    dist = "distance" if replay else "distance_2d"
    health = "health > 0" if alive else "TRUE"
    team = "a.first_team" if first_team else "a.team_num"
    runs = """
  SELECT match_id, steamid, max(c) AS run FROM (
    SELECT match_id, steamid, target, count(*) AS c FROM (
      SELECT *, tick - row_number() OVER (PARTITION BY match_id, steamid, target ORDER BY tick) AS island
      FROM {rows}) GROUP BY match_id, steamid, target, island) {having} GROUP BY 1, 2"""
    strict_runs = runs.format(rows="pairs_r WHERE error < 2.5", having="")
    active = runs.format(rows="moved WHERE abs(dy_) > 0.1 OR abs(dx_) > 1", having="WHERE c >= 2")
    full = "coalesce(rows_ >= 50, FALSE)" if replay else "coalesce(rows_ >= 1, FALSE)"
    return f""",
occ_base AS (
  SELECT *, first(team_num) OVER (PARTITION BY match_id, steamid ORDER BY tick) AS first_team FROM ticks WHERE {health}),
pairs0 AS (
  SELECT a.match_id, a.tick, a.steamid, b.steamid AS target, b.name AS target_name, a.yaw, a.pitch, b.X AS xe, b.spotted,
         b.X - a.X AS dx, b.Y - a.Y AS dy, b.Z - a.Z AS dz
  FROM occ_base a JOIN occ_base b ON a.match_id = b.match_id AND a.tick = b.tick AND a.steamid <> b.steamid
       AND {team} <> b.team_num),
pairs1 AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS distance_2d FROM pairs0),
pairs2 AS (
  SELECT *, sqrt(distance_2d * distance_2d + dz * dz) AS distance, degrees(atan2(dy, dx)) AS yaw_to,
         -degrees(atan2(dz, greatest(distance_2d, 1))) AS pitch_to FROM pairs1),
pairs AS (
  SELECT *, sqrt(pow({wrap_sql('yaw_to - yaw')}, 2) + pow(pitch_to - pitch, 2)) AS error FROM pairs2),
pairs_r AS (SELECT * FROM pairs WHERE NOT spotted AND {dist} BETWEEN 200 AND 2000),
locks AS (
  SELECT match_id, steamid, count(*) FILTER (error < 5) AS wide, count(*) FILTER (error < 2.5) AS strict,
         count(*) FILTER (distance <= 1000 AND error < 10) AS preaim, avg(distance) FILTER (error < 5) AS wide_distance
  FROM pairs_r GROUP BY 1, 2),
moved AS (
  SELECT *, yaw - lag(yaw) OVER (PARTITION BY match_id, steamid, target ORDER BY tick) AS dy_,
         xe - lag(xe) OVER (PARTITION BY match_id, steamid, target ORDER BY tick) AS dx_
  FROM pairs_r WHERE error < 2.5),
strict_runs AS ({strict_runs}),
active_runs AS ({active}),
occ_rows AS (SELECT match_id, steamid, count(*) AS rows_ FROM occ_base GROUP BY 1, 2),
occ_roster AS (SELECT DISTINCT match_id, steamid FROM ticks)
""" + ("" if not replay else """,
near_ AS (
  SELECT DISTINCT match_id, steamid, tick + o AS tick FROM pairs_r, (SELECT unnest(generate_series(-10, 10)) AS o) WHERE error < 5),
timing AS (
  SELECT k.match_id, k.steamid, count(n.tick) / count(*) AS info_timing
  FROM kin k LEFT JOIN near_ n USING (match_id, steamid, tick) WHERE k.yaw_step > 15 AND k.row_n > 20 GROUP BY 1, 2)
""") + f""",
m_occ AS (
  SELECT match_id, steamid,
         CASE WHEN {full} THEN round(coalesce(wide / rows_, 0), 4) ELSE 0 END AS wh_ratio_lock_cache,
         CASE WHEN {full} THEN round(coalesce(strict / rows_, 0), 4) ELSE 0 END AS wh_ratio_lock_strict,
         CAST(CASE WHEN {full} THEN coalesce(run, 0) ELSE 0 END AS DOUBLE) AS wh_tracking_consecutif_max,
         CASE WHEN {full} THEN round(coalesce(wide_distance, 0), 2) ELSE 0 END AS wh_distance_moyenne_verrous,
         {f"CASE WHEN {full} THEN round(coalesce(preaim / rows_, 0), 4) ELSE 0 END" if replay else "0.0::DOUBLE"} AS wh_preaim_score,
         {f"CASE WHEN {full} AND coalesce(wide, 0) > 0 THEN round(coalesce(info_timing, 0), 4) ELSE 0 END" if replay else "0.0::DOUBLE"} AS wh_info_timing_ratio
  FROM occ_roster LEFT JOIN occ_rows USING (match_id, steamid) LEFT JOIN locks USING (match_id, steamid)
  LEFT JOIN {"active_runs" if replay else "strict_runs"} USING (match_id, steamid)
  {"LEFT JOIN timing USING (match_id, steamid)" if replay else ""})
"""


def _ray_sql(radius: float, j: str = "a", e: str = "b") -> str:
    """Ray against head sphere; the eye and head heights cancel."""
    v = [f"({e}.{c} - {j}.{c})" for c in "XY"] + [f"(({e}.Z + 64) - ({j}.Z + 64))"]
    d = [f"cos(radians({j}.pitch)) * cos(radians({j}.yaw))", f"cos(radians({j}.pitch)) * sin(radians({j}.yaw))",
         f"(-sin(radians({j}.pitch)))"]
    t = "(" + " + ".join(f"{a} * {b}" for a, b in zip(v, d)) + ")"
    miss = " + ".join(f"pow({t} * {b} - {a}, 2)" for a, b in zip(v, d))
    return f"({t} >= 0 AND sqrt({miss}) <= {radius})"


def trigger_ctes(radius: float = 200.0) -> str:
    return f""",
tlive AS (SELECT * FROM ticks WHERE health > 0),
shots AS (SELECT DISTINCT match_id, user_steamid AS steamid, tick FROM fires),
hits AS (
  SELECT a.match_id, a.steamid, a.tick AS shot_tick, min(b.steamid) AS target
  FROM tlive a JOIN shots s USING (match_id, steamid, tick)
  JOIN tlive b ON a.match_id = b.match_id AND a.tick = b.tick AND a.steamid <> b.steamid AND a.team_num <> b.team_num
  WHERE {_ray_sql(radius)} GROUP BY 1, 2, 3),
back AS (
  SELECT h.match_id, h.steamid, h.shot_tick, h.target, h.shot_tick - a.tick AS ago,
         coalesce({_ray_sql(radius)}, FALSE) AS on_
  FROM hits h JOIN tlive a ON a.match_id = h.match_id AND a.steamid = h.steamid AND a.tick BETWEEN h.shot_tick - 63 AND h.shot_tick
  LEFT JOIN tlive b ON b.match_id = h.match_id AND b.steamid = h.target AND b.tick = a.tick),
stop AS (SELECT match_id, steamid, shot_tick, target, coalesce(min(ago) FILTER (NOT on_), 64) AS miss FROM back GROUP BY 1, 2, 3, 4),
reactions AS (
  SELECT match_id, steamid, shot_tick, target, CAST(coalesce(max(ago) FILTER (on_ AND ago < miss), 0) AS BIGINT) AS ticks_aligned,
         coalesce(max(ago) FILTER (on_ AND ago < miss), 0) / 64.0::DOUBLE * 1000 AS reaction_ms
  FROM back JOIN stop USING (match_id, steamid, shot_tick, target) GROUP BY 1, 2, 3, 4),
fast AS (
  SELECT *, sum((reaction_ms >= 30)::INT) OVER (PARTITION BY match_id, steamid ORDER BY shot_tick) AS island FROM reactions),
bursts AS (
  SELECT match_id, steamid, count(*) FILTER (c >= 3) AS bursts FROM (
    SELECT match_id, steamid, count(*) AS c FROM fast WHERE reaction_ms < 30 GROUP BY match_id, steamid, island) GROUP BY 1, 2),
rt AS (
  SELECT match_id, steamid, round(quantile_cont(reaction_ms, 0.5), 2) AS m, round(stddev_pop(reaction_ms), 2) AS s,
         round(min(reaction_ms), 2) AS lo, count(*) AS n FROM reactions GROUP BY 1, 2),
m_trig AS (
  SELECT match_id, steamid, coalesce(m, 0) AS triggerbot_rt_median, coalesce(s, 0) AS triggerbot_rt_std,
         coalesce(lo, 0) AS triggerbot_rt_min, CAST(coalesce(bursts, 0) AS BIGINT) AS triggerbot_burst_count,
         CAST(coalesce(n, 0) AS BIGINT) AS triggerbot_total_shots_analyzed
  FROM (SELECT DISTINCT match_id, steamid FROM ticks) LEFT JOIN rt USING (match_id, steamid) LEFT JOIN bursts USING (match_id, steamid))
"""


METRICS_SQL = AIM_SQL + bhop_ctes(False) + SPIN_CTES + occ_ctes() + trigger_ctes() + """,
people AS (
  SELECT match_id, steamid, min(name) AS name, min(team_num) AS team_number, sum(event_id) % 1000 / 10.0::DOUBLE AS ml_score
  FROM ticks GROUP BY 1, 2),
metrics AS (
  SELECT * FROM people LEFT JOIN m_aim USING (match_id, steamid) LEFT JOIN m_bhop USING (match_id, steamid)
  LEFT JOIN m_spin USING (match_id, steamid) LEFT JOIN m_occ USING (match_id, steamid) LEFT JOIN m_trig USING (match_id, steamid))
"""

SCALED_SQL = METRICS_SQL + ",\nsm AS (SELECT * REPLACE (" + ", ".join(
    f"{re.sub(r'([0-9.]+)D', r'(\1::DOUBLE)', e)} AS {c}" for c, e in SCALED.items()) + ") FROM metrics)\n"


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
