"""Queries of scalar math, cleaning, selection and projections."""

from pyspark.sql import functions as F

from tickscope.functions import angles, text
from tickscope.functions.numbers import stable_round
from tickscope.operators import clean, results, rules
from tickscope.operators.blocks import PLAYER
from tickscope.plans import inputs as I
from tickscope.plans.inputs import _ray_sql, wrap_sql
from tickscope.plans.registry import query


def rnd(x, name, digits=6):
    return stable_round(x, digits).alias(name)


def ev(spark, sf):
    return I.table(spark, sf, "events")


# --- math --------------------------------------------------------------------------------------------------------

@query("MTH-1", f"SELECT event_id, round({wrap_sql('value * 9.0::DOUBLE - 700.0::DOUBLE')}, 6) AS angle FROM events")
def mth1(spark, sf):
    return ev(spark, sf).select("event_id", rnd(angles.normalize_angle(F.col("value") * 9.0 - 700.0), "angle"))


@query("MTH-2", f"SELECT event_id, round({wrap_sql('value * 9.0::DOUBLE - 700.0::DOUBLE - value * 2.0::DOUBLE')}, 6) AS delta FROM events")
def mth2(spark, sf):
    return ev(spark, sf).select("event_id", rnd(angles.angular_delta(F.col("value") * 2.0, F.col("value") * 9.0 - 700.0), "delta"))


A3 = """SELECT event_id, X - 1500.0::DOUBLE AS dx, Y - 1500.0::DOUBLE AS dy, Z - 64.0::DOUBLE AS dz FROM ticks"""


@query("MTH-3", I.with_sql(I.BASE_SQL, f""", d AS ({A3}), e AS (SELECT *, sqrt(dx * dx + dy * dy) AS d2 FROM d),
  f AS (SELECT *, -degrees(atan2(dz, greatest(d2, 1))) AS p FROM e)
  SELECT event_id, round(CASE WHEN d2 = 0 AND abs(dz) <= 2 THEN 0 ELSE degrees(atan2(dy, dx)) END, 6) AS yaw,
         round(CASE WHEN (d2 = 0 AND abs(dz) <= 2) OR abs(p) < 2 THEN 0 ELSE p END, 6) AS pitch,
         round(CASE WHEN d2 = 0 AND abs(dz) <= 2 THEN 0 ELSE sqrt(d2 * d2 + dz * dz) END, 6) AS distance FROM f"""))
def mth3(spark, sf):
    a = angles.aim_angles_3d(1500.0, 1500.0, 64.0, "X", "Y", "Z")
    return I.ticks(spark, sf).select("event_id", a.alias("a")).select(
        "event_id", rnd("a.yaw", "yaw"), rnd("a.pitch", "pitch"), rnd("a.distance", "distance"))


@query("MTH-4", I.with_sql(I.BASE_SQL, f""", d AS ({A3})
  SELECT event_id, round(degrees(atan2(dy, dx)), 6) AS yaw,
         round(-degrees(atan2(dz, greatest(sqrt(dx * dx + dy * dy), 1))), 6) AS pitch FROM d"""))
def mth4(spark, sf):
    yaw, pitch = angles.bearing(F.col("X") - 1500.0, F.col("Y") - 1500.0, F.col("Z") - 64.0)
    return I.ticks(spark, sf).select("event_id", rnd(yaw, "yaw"), rnd(pitch, "pitch"))


@query("MTH-5", I.with_sql(I.BASE_SQL, f"""SELECT event_id,
  round(sqrt(pow({wrap_sql('X - yaw')}, 2) + pow(Z - pitch, 2)), 6) AS error FROM ticks"""))
def mth5(spark, sf):
    return I.ticks(spark, sf).select("event_id", rnd(angles.angular_error("X", "Z", "yaw", "pitch"), "error"))


@query("MTH-6", I.with_sql(I.BASE_SQL, f"""SELECT a.event_id, {_ray_sql(400.0)} AS hit FROM ticks a,
  (SELECT 1500.0::DOUBLE AS X, 1500.0::DOUBLE AS Y, 0.0::DOUBLE AS Z) b"""))
def mth6(spark, sf):
    hit = angles.ray_hits_sphere("X", "Y", "Z", "yaw", "pitch", 1500.0, 1500.0, 0.0, 400.0)
    return I.ticks(spark, sf).select("event_id", hit.alias("hit"))


@query("MTH-7", I.with_sql(I.BASE_SQL, "SELECT event_id, round(sqrt(velocity_X * velocity_X + velocity_Y * velocity_Y), 6) AS speed FROM ticks"))
def mth7(spark, sf):
    return I.ticks(spark, sf).select("event_id", rnd(angles.horizontal_speed("velocity_X", "velocity_Y"), "speed"))


@query("MTH-8", "SELECT event_id, round(1 / (1 + exp(10 * (value - 50) / 500)), 6) AS anomaly FROM events")
def mth8(spark, sf):
    return ev(spark, sf).select("event_id", rnd(angles.anomaly_sigmoid((F.col("value") - 50.0) / 500.0), "anomaly"))


@query("MTH-9", I.with_sql(I.BASE_SQL, "SELECT event_id, round(tick / 64.0::DOUBLE * 1000, 6) AS ms, round(tick / 64.0::DOUBLE, 6) AS seconds FROM ticks"))
def mth9(spark, sf):
    return I.ticks(spark, sf).select("event_id", rnd(angles.ticks_to_ms("tick"), "ms"), rnd(angles.ticks_to_seconds("tick"), "seconds"))


# --- cleaning ----------------------------------------------------------------------------------------------------

RAW = "CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1 THEN props ELSE CAST(event_id * 3 AS VARCHAR) END"


@query("CLN-1", f"SELECT event_id, TRY_CAST({RAW} AS BIGINT) AS tick, TRY_CAST(props AS DOUBLE) AS health FROM events")
def cln1(spark, sf):
    raw = ev(spark, sf).select("event_id", F.expr(RAW.replace("VARCHAR", "STRING")).alias("tick"), F.col("props").alias("health"))
    return clean.coerce_numeric(raw, {"tick": "long", "health": "double"})


@query("CLN-2", I.with_sql(I.BASE_SQL, """, d AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 = 0 THEN 'inf'::DOUBLE ELSE X END AS X,
  CASE WHEN event_id % 19 = 0 THEN '-inf'::DOUBLE ELSE yaw END AS yaw FROM ticks)
  SELECT event_id, X, round(yaw, 6) AS yaw FROM d WHERE isfinite(X) AND isfinite(yaw)"""))
def cln2(spark, sf):
    e = F.col("event_id")
    d = I.ticks(spark, sf).select(
        "event_id", F.when(e % 13 == 0, F.lit(float("nan"))).when(e % 17 == 0, F.lit(float("inf"))).otherwise(F.col("X")).alias("X"),
        F.when(e % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("yaw")).alias("yaw"))
    return clean.drop_non_finite(d, ("X", "yaw")).select("event_id", "X", rnd("yaw", "yaw"))


@query("CLN-3", I.with_sql(I.BASE_SQL, """SELECT match_id, steamid, tick // 2 AS tick, min(event_id) AS event_id FROM ticks GROUP BY 1, 2, 3"""))
def cln3(spark, sf):
    d = I.ticks(spark, sf).withColumn("tick", F.expr("tick div 2"))
    return clean.deduplicate_ticks(d, ("event_id",)).select(*PLAYER, "tick", "event_id")


RAW_ID = """CASE event_id % 8 WHEN 0 THEN ' ' || CAST(user_id + 76561190000000000 AS VARCHAR) || '.0 ' WHEN 1 THEN 'nan' WHEN 2 THEN '0'
  WHEN 3 THEN '' WHEN 4 THEN 'None' WHEN 5 THEN CAST(user_id AS VARCHAR) ELSE 'Player_' || CAST(user_id AS VARCHAR) END"""


@query("CLN-4", f"""WITH d AS (SELECT event_id, regexp_replace(trim({RAW_ID}), '\\.0$', '') AS steamid FROM events)
  SELECT * FROM d WHERE steamid NOT IN ('', '0', 'nan', 'None') AND length(steamid) >= 5""")
def cln4(spark, sf):
    return clean.clean_ids(ev(spark, sf).select("event_id", F.expr(RAW_ID.replace("VARCHAR", "STRING")).alias("steamid")))


def hurt(t):
    """Derived damage events: the attacker is the player, the victim the next one of the match."""
    return t.where("active_weapon_name = 'click'").select(
        "match_id", "tick", F.col("event_id").alias("event_uid"), F.col("steamid").alias("attacker_steamid"),
        F.when(F.col("event_id") % 4 == 0, F.col("steamid")).otherwise(F.concat(F.lit("Player_"), (F.col("event_id") % 10).cast("string"))).alias("user_steamid"))


HURT_SQL = """, hurt AS (SELECT match_id, tick, event_id AS event_uid, steamid AS attacker_steamid,
  CASE WHEN event_id % 4 = 0 THEN steamid ELSE 'Player_' || CAST(event_id % 10 AS VARCHAR) END AS user_steamid
  FROM ticks WHERE active_weapon_name = 'click')"""


@query("CLN-5", I.with_sql(I.BASE_SQL, HURT_SQL + """
  SELECT match_id, 'weapon_fire' AS event_name, tick, user_steamid AS actor, NULL AS victim, user_steamid AS user_name, weapon FROM fires
  UNION ALL SELECT match_id, 'player_hurt', tick, attacker_steamid, user_steamid, user_steamid, NULL FROM hurt"""))
def cln5(spark, sf):
    t = I.ticks(spark, sf)
    return clean.normalize_events(I.fires(t), "weapon_fire").unionByName(clean.normalize_events(hurt(t), "player_hurt"))


# --- selection ---------------------------------------------------------------------------------------------------

@query("FLT-1", I.with_sql(I.BASE_SQL, "SELECT event_id, match_id, steamid, tick FROM ticks WHERE health > 0"))
def flt1(spark, sf):
    return clean.alive(I.ticks(spark, sf)).select("event_id", *PLAYER, "tick")


@query("FLT-2", I.with_sql(I.BASE_SQL, """, d AS (SELECT *, CASE WHEN steamid LIKE 'Player_%' AND user_mod = 0 THEN 0 ELSE health END AS h FROM
  (SELECT *, CAST(substr(name, 2) AS BIGINT) % 10 AS user_mod FROM ticks)),
  e AS (SELECT *, max(h) OVER (PARTITION BY match_id, steamid) AS best FROM d)
  SELECT match_id, steamid, tick, row_number() OVER (PARTITION BY match_id, steamid ORDER BY tick) AS row_i,
         count(*) OVER (PARTITION BY match_id, steamid) AS row_n FROM e WHERE h > 0 OR best = 0"""))
def flt2(spark, sf):
    from tickscope.operators.timeline import timeline
    dead = F.col("steamid").startswith("Player_") & (F.expr("cast(substring(name, 2) as bigint)") % 10 == 0)
    t = I.ticks(spark, sf).withColumn("health", F.when(dead, 0).otherwise(F.col("health")))
    return timeline(t).select(*PLAYER, "tick", "row_i", "row_n")


@query("FLT-3", I.with_sql(I.BASE_SQL, """SELECT event_id, steamid, name, 'id' AS given FROM ticks WHERE steamid = 'Player_5' OR name = 'Player_5'
  UNION ALL SELECT event_id, steamid, name, 'name' FROM ticks WHERE steamid = 'p7' OR name = 'p7'"""))
def flt3(spark, sf):
    t = I.ticks(spark, sf)
    a = clean.player_rows(t, " Player_5 ").select("event_id", "steamid", "name", F.lit("id").alias("given"))
    return a.unionByName(clean.player_rows(t, "p7").select("event_id", "steamid", "name", F.lit("name").alias("given")))


@query("FLT-4", I.with_sql(I.BASE_SQL, HURT_SQL + """, p AS (SELECT event_uid, match_id, tick, attacker_steamid AS person FROM hurt
  UNION SELECT event_uid, match_id, tick, user_steamid FROM hurt)
  SELECT p.match_id, person AS steamid, count(*) AS events, min(tick) AS first_tick FROM p
  JOIN (SELECT DISTINCT match_id, steamid FROM ticks) r ON p.match_id = r.match_id AND p.person = r.steamid GROUP BY 1, 2"""))
def flt4(spark, sf):
    t = I.ticks(spark, sf)
    people = clean.events_by_player(hurt(t)).withColumnRenamed("person", "steamid")
    counts = people.groupBy(*PLAYER).agg(F.count(F.lit(1)).alias("events"), F.min("tick").alias("first_tick"))
    return counts.join(results.roster(t), [*PLAYER], "left_semi")


@query("FLT-5", I.with_sql(I.BASE_SQL, """, p AS (SELECT match_id, steamid, min(team_num) AS team_number FROM ticks GROUP BY 1, 2)
  SELECT 'CT' AS filter, * FROM p WHERE team_number = 3 UNION ALL SELECT 'T', * FROM p WHERE team_number = 2 UNION ALL SELECT 'all', * FROM p"""))
def flt5(spark, sf):
    p = results.main_team(I.ticks(spark, sf))
    out = None
    for f in ("CT", "T", "all"):
        d = clean.team_filter(p, f).select(F.lit(f).alias("filter"), *PLAYER, "team_number")
        out = d if out is None else out.unionByName(d)
    return out


# --- projections -------------------------------------------------------------------------------------------------

PEOPLE = ", p AS (SELECT match_id, steamid, min(name) AS name, min(team_num) AS team_number FROM ticks GROUP BY 1, 2)"


@query("PRJ-1", I.with_sql(I.BASE_SQL, PEOPLE + """SELECT match_id, steamid, regexp_full_match(steamid, '[0-9]{17}') AS valid,
  CASE WHEN regexp_full_match(steamid, '[0-9]{17}') THEN steamid END AS steamid64,
  NOT regexp_full_match(steamid, '[0-9]{17}') OR starts_with(steamid, 'Player_') AS anonymized FROM p"""))
def prj1(spark, sf):
    return results.players(I.ticks(spark, sf)).select(
        *PLAYER, text.is_steam_id("steamid").alias("valid"), text.steamid64("steamid").alias("steamid64"),
        text.is_anonymized("steamid").alias("anonymized"))


@query("PRJ-2", I.with_sql(I.BASE_SQL, PEOPLE + """SELECT match_id, steamid,
  CASE WHEN regexp_full_match(steamid, '[0-9]{17}') THEN 'https://steamcommunity.com/profiles/' || steamid ELSE '' END AS steam_url,
  CASE WHEN regexp_full_match(steamid, '[0-9]{17}') THEN 'https://faceitfinder.com/profile/' || steamid ELSE '' END AS faceit_url FROM p"""))
def prj2(spark, sf):
    return results.players(I.ticks(spark, sf)).select(
        *PLAYER, text.profile_url("steamid").alias("steam_url"), text.profile_url("steamid", text.FACEIT_PROFILE).alias("faceit_url"))


@query("PRJ-3", "SELECT event_id, round(CASE WHEN value / 100 > 0 AND value / 100 <= 1 THEN value / 100 * 100 ELSE value / 100 END, 6) AS pct FROM events")
def prj3(spark, sf):
    return ev(spark, sf).select("event_id", rnd(text.ratio_to_percent(F.col("value") / 100.0), "pct"))


@query("PRJ-4", """WITH d AS (SELECT event_id, CAST(event_id * event_id * event_id % 4000000007 // CASE event_id % 4 WHEN 0 THEN 4000000 WHEN 1 THEN 4000 WHEN 2 THEN 40 ELSE 1 END AS BIGINT) AS n, ts FROM events)
  SELECT event_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
    WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS readable,
    round(n / 1048576, 2) AS mb, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM d""")
def prj4(spark, sf):
    # the cube leaves 64 bits from event 2,097,152 on: remainders are multiplied as decimals, which hold every product
    rest = "cast(event_id % 4000000007L as decimal(10, 0))"
    n = F.expr(f"""cast({rest} * {rest} % 4000000007L * {rest} % 4000000007L as bigint) div
                  case event_id % 4 when 0 then 4000000 when 1 then 4000 when 2 then 40 else 1 end""")
    return ev(spark, sf).select("event_id", "ts", n.alias("n")).select(
        "event_id", text.readable_size("n").alias("readable"), rnd(F.col("n") / 1048576.0, "mb", 2), text.iso_time("ts").alias("iso"))


@query("PRJ-5", I.with_sql(I.BASE_SQL, """, m AS (SELECT match_id, max(tick) - min(tick) + 1 AS n, CAST(substr(match_id, 2) AS BIGINT) AS k FROM ticks GROUP BY 1)
  SELECT match_id, CASE WHEN k % 3 = 0 THEN 'CARTE INCONNUE' ELSE 'DE_MAP' || CAST(k AS VARCHAR) END AS map,
         CASE WHEN k % 2 = 0 THEN 'Serveur CS2' ELSE 'srv' || CAST(k AS VARCHAR) END AS server,
         printf('%02dm %02ds', n * 50 // 64 // 60, n * 50 // 64 % 60) AS duration, 'm' || CAST(k AS VARCHAR) || '.dem' AS file,
         CASE WHEN k % 3 = 0 THEN 'Inconnue' ELSE 'de_map' || CAST(k AS VARCHAR) END AS context_map,
         CASE WHEN k % 4 = 0 THEN 'demo_inconnue.dem' ELSE 'm' || CAST(k AS VARCHAR) || '.dem' END AS context_file FROM m"""))
def prj5(spark, sf):
    m = results.match_span(I.ticks(spark, sf)).withColumn("k", F.expr("cast(substring(match_id, 2) as bigint)"))
    k = F.col("k").cast("string")
    m = m.withColumns({"map_name": F.when(F.col("k") % 3 != 0, F.concat(F.lit("de_map"), k)),
                       "server_name": F.when(F.col("k") % 2 == 0, "unknown").otherwise(F.concat(F.lit("srv"), k)),
                       "path": F.concat(F.lit("/replays/"), F.col("match_id"), F.lit(".dem"))})
    return m.select("match_id", text.map_label("map_name").alias("map"), text.server_label("server_name").alias("server"),
                    text.duration_label(F.col("duration_seconds") * 50).alias("duration"), text.file_name("path").alias("file"),
                    text.replay_context("map_name", "server_name", F.lit(""), F.when(F.col("k") % 4 != 0, F.col("path"))).alias("c")).select(
        "match_id", "map", "server", "duration", "file", F.col("c.map_name").alias("context_map"), F.col("c.demo_filename").alias("context_file"))


@query("PRJ-6", I.with_sql(I.BASE_SQL, "SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'T' WHEN 3 THEN 'CT' ELSE 'SPEC' END AS team FROM ticks"))
def prj6(spark, sf):
    return I.ticks(spark, sf).select("event_id", text.team_label(F.col("event_id") % 4).alias("team"))


@query("PRJ-7", """WITH d AS (SELECT event_id, value - 20 AS score,
    CASE event_id % 7 WHEN 0 THEN ' clean ' WHEN 1 THEN 'Suspect' WHEN 2 THEN 'CHEATER' WHEN 3 THEN 'error' WHEN 4 THEN 'INDISPONIBLE' WHEN 5 THEN 'UNAVAILABLE' ELSE 'CLEAN' END AS v,
    CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'OK' WHEN 2 THEN 'insufficient_data' WHEN 3 THEN 'Error ' ELSE 'ok' END AS s FROM events),
  e AS (SELECT *, upper(trim(v)) AS nv, lower(trim(s)) AS ns FROM d),
  f AS (SELECT *, CASE WHEN nv = 'ERROR' OR ns = 'error' THEN 'ERROR' WHEN nv IN ('INSUFFICIENT_DATA', 'INDISPONIBLE') OR ns = 'insufficient_data' THEN 'INSUFFICIENT_DATA'
      WHEN nv IN ('CLEAN', 'SUSPECT', 'CHEATER') THEN nv ELSE 'ERROR' END AS verdict FROM e)
  SELECT event_id, verdict, round(least(greatest(score, 0), 100), 4) AS suspicion_score,
    CASE verdict WHEN 'ERROR' THEN 'error' WHEN 'INSUFFICIENT_DATA' THEN 'insufficient_data' ELSE 'ok' END AS analysis_status,
    CASE WHEN verdict IN ('ERROR', 'INSUFFICIENT_DATA') THEN 'insufficient' ELSE 'good' END AS data_quality FROM f""")
def prj7(spark, sf):
    v = F.element_at(F.array(*[F.lit(x) for x in (" clean ", "Suspect", "CHEATER", "error", "INDISPONIBLE", "UNAVAILABLE", "CLEAN")]),
                     (F.col("event_id") % 7 + 1).cast("int"))
    s = F.element_at(F.array(*[F.lit(x) for x in ("ok", "OK", "insufficient_data", "Error ", "ok")]), (F.col("event_id") % 5 + 1).cast("int"))
    d = ev(spark, sf).select("event_id", (F.col("value") - 20.0).alias("suspicion_score"), v.alias("verdict"), s.alias("analysis_status"))
    return rules.normalize_result(d).withColumn("suspicion_score", stable_round("suspicion_score", 4))
