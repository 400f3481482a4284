"""Queries of rosters, rankings, set operations, joins, rules, verdicts and reports."""

from pyspark.sql import functions as F

from tickscope.functions.numbers import stable_round
from tickscope.operators import aim, bhop, occlusion, reports, results, rules, spin, trigger
from tickscope.operators.blocks import PLAYER
from tickscope.plans import inputs as I
from tickscope.plans.analyze import combat_events, judge, player_metrics
from tickscope.plans.registry import query
from tickscope.sources import result_store
from tickscope.sources.workdir import materialize, new_path

RULE_CFG = rules.DEFAULT


def f1(x, digits=1):
    return f"printf('%.{digits}f', {x})"


def n0(x):
    return f"CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR)"


# --- rules in SQL: id, condition, factor, cheat, pills ----------------------------------------------------------------
P99, JERK = f1("aim_p99"), f1("aim_jerk_max")
RAT1, RAT0 = f1("bhop_ratio_parfaits * 100"), f1("bhop_ratio_parfaits * 100", 0)
STRICT, RUN, CHAIN = f1("wh_ratio_lock_strict * 100"), n0("wh_tracking_consecutif_max"), n0("bhop_chaine_max")
SPINV, FLIPS = f1("spinbot_yaw_speed_max"), n0("spinbot_desync_max_ticks")
MED1, MED0, STD1, STD0 = f1("triggerbot_rt_median"), f1("triggerbot_rt_median", 0), f1("triggerbot_rt_std"), f1("triggerbot_rt_std", 0)
RULE_SQL = [
    ("RUL-1", "aim_p99 > 18", f"'Snap instantané anormal (' || {P99} || '°/tick)'", f"'AIMBOT: Snap ' || {P99} || '°/tick'", None),
    ("RUL-2", "aim_jerk_max > 45", f"'À-coups mécaniques suspects (' || {JERK} || ')'", f"'AIMBOT: Jerk ' || {JERK}", None),
    ("RUL-3", "bhop_ratio_parfaits > 0.55 AND bhop_total_sauts >= 12", f"'Bhop scripté (' || {RAT1} || '% parfaits)'", f"'BHOP: Script ' || {RAT0} || '%'", None),
    ("RUL-4", "bhop_chaine_max >= 4", f"'Chaîne de BunnyHop suspecte (' || {CHAIN} || ' consécutifs)'", f"'BHOP: Chaîne ' || {CHAIN}", [f"'[BHOP: Chaîne x' || {CHAIN} || ']'"]),
    ("RUL-5", "wh_ratio_lock_strict > 0.12 AND wh_tracking_consecutif_max >= 80", f"'Alignement occlus suspect (' || {STRICT} || '%)'", f"'INFO-ESP: ' || {RUN} || ' Locks'",
     [f"'[INFO-ESP: ' || {STRICT} || '% Lock Non-Vu]'", f"'[WALLHACK: ' || {STRICT} || '% Lock Mur]'"]),
    ("RUL-6", "wh_tracking_consecutif_max >= 180", f"'Suivi occlus continu anormal (' || {RUN} || ' ticks)'", f"'INFO-ESP: Track ' || {RUN} || 't'",
     [f"'[INFO-ESP: Track ' || {RUN} || ' ticks]'", f"'[WALLHACK: Track ' || {RUN} || ' ticks]'"]),
    ("RUL-7", "spinbot_yaw_speed_max > 90 OR spinbot_yaw_spin_windows > 0", f"'Rotation spinbot violente (' || {SPINV} || '°/tick)'", f"'SPINBOT: Spin ' || {SPINV} || '°/tick'", None),
    ("RUL-8", "spinbot_pitch_violations > 0", "'Pitch anti-aim hors limites Source 2'", "'[ANTI-AIM: Pitch invalide]'", "same"),
    ("RUL-9", "spinbot_jitter_score > 2000", "'Jitter anti-aim détecté'", "'[ANTI-AIM: Jitter]'", "same"),
    ("RUL-10", "spinbot_desync_max_ticks >= 6", f"'Oscillation anti-aim (' || {FLIPS} || ' flips)'", f"'[ANTI-AIM: Flip ' || {FLIPS} || 't]'", "same"),
    ("RUL-11", "triggerbot_total_shots_analyzed >= 3 AND triggerbot_rt_median < 50", f"'Latence alignement-tir anormalement basse (' || {MED1} || 'ms)'", f"'TRIGGERBOT: Réaction ' || {MED0} || 'ms'", None),
    ("RUL-12", "triggerbot_total_shots_analyzed >= 3 AND triggerbot_rt_std < 15", f"'Régularité de tir statistiquement anormale (σ ' || {STD1} || 'ms)'", f"'TRIGGERBOT: Régularité ' || {STD0} || 'ms'", None),
    ("RUL-13", "triggerbot_burst_count >= 1", f"'Rafales triggerbot instantanées (' || {n0('triggerbot_burst_count')} || 'x)'", f"'TRIGGERBOT: Burst x' || {n0('triggerbot_burst_count')}", None),
]


def pills_of(cheat, pills):
    return [f"'[' || {cheat} || ']'"] if pills is None else [cheat] if pills == "same" else pills


def arr(items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


FLAGS_SQL = I.SCALED_SQL + ", fl AS (SELECT *, " + arr([f"CASE WHEN {c} THEN {f} END" for _, c, f, _, _ in RULE_SQL]) + " AS factors, " \
    + arr([f"CASE WHEN {c} THEN {p} END" for _, c, _, ch, pl in RULE_SQL for p in pills_of(ch, pl)]) + " AS pills, " \
    + arr([f"CASE WHEN {c} THEN {ch} END" for _, c, _, ch, _ in RULE_SQL]) + """ AS cheats,
  coalesce((spinbot_yaw_speed_max > 90 OR spinbot_yaw_spin_windows > 0) OR spinbot_pitch_violations > 0, FALSE) AS rage FROM sm)
"""
THR_SQL = FLAGS_SQL + """, th AS (SELECT *, CASE WHEN CAST(substr(match_id, 2) AS BIGINT) % 2 = 0 THEN 80.0::DOUBLE ELSE 80.0::DOUBLE END AS threshold_high,
  60.0::DOUBLE AS threshold_suspect FROM fl),
sc AS (SELECT *, CASE WHEN rage THEN greatest(ml_score, 90, threshold_high) WHEN len(factors) >= 2 THEN greatest(ml_score, 75, threshold_high)
    WHEN len(factors) >= 1 THEN greatest(ml_score, 45, threshold_suspect)
    WHEN aim_vitesse_max = 0 AND aim_p99 = 0 AND bhop_total_sauts = 0 AND wh_ratio_lock_strict = 0 THEN least(ml_score, 5) ELSE ml_score END AS raw FROM th),
vd AS (SELECT *, round(raw, 2) AS suspicion_score, CASE WHEN rage OR raw >= threshold_high OR len(factors) >= 2 THEN 'CHEATER'
    WHEN len(factors) >= 1 OR raw >= threshold_suspect THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict FROM sc)
"""


def flagged(spark, sf):
    return rules.with_flags(I.scaled_metrics(spark, sf))


def judged(spark, sf):
    return judge(I.scaled_metrics(spark, sf))


def _register_rule(rule_id, cond, factor, cheat, pills):
    joined = " || ' | ' || ".join(pills_of(cheat, pills))

    @query(rule_id, I.with_sql(I.SCALED_SQL, f"""SELECT match_id, steamid, '{rule_id}' AS rule, {factor} AS factor, {cheat} AS cheat,
      {joined} AS pills FROM sm WHERE {cond}"""))
    def one(spark, sf):
        return rules.rule_hits(I.scaled_metrics(spark, sf), only=rule_id).select(
            *PLAYER, "rule", "factor", "cheat", F.array_join("pills", " | ").alias("pills"))


for _r in RULE_SQL:
    _register_rule(*_r)


@query("RUL-14", I.with_sql(FLAGS_SQL, """SELECT match_id, steamid, array_to_string(factors, ' | ') AS factors,
  array_to_string(cheats, ' | ') AS cheats, array_to_string(pills, ' | ') AS pills, rage FROM fl"""))
def rul14(spark, sf):
    return flagged(spark, sf).select(*PLAYER, *[F.array_join(c, " | ").alias(c) for c in ("factors", "cheats", "pills")], "rage")


# --- verdicts ----------------------------------------------------------------------------------------------------

@query("VRD-1", I.with_sql(I.BASE_SQL, """, md AS (SELECT round(0.5 + (max(CAST(substr(match_id, 2) AS BIGINT)) % 4) / 10, 2) AS hi FROM ticks)
  SELECT DISTINCT t.match_id, t.steamid, round(hi * 100, 4) AS threshold_high, round(0.6 * 100, 4) AS threshold_suspect FROM ticks t, md"""))
def vrd1(spark, sf):
    t = I.ticks(spark, sf)
    model = t.agg(stable_round(0.5 + F.max(F.expr("cast(substring(match_id, 2) as bigint)")) % 4 / 10.0, 2).alias("threshold")).withColumns(
        {"threshold_high": F.lit(None).cast("double"), "threshold_suspect": F.lit(None).cast("double")})
    d = rules.with_thresholds(results.roster(t), model)
    return d.select(*PLAYER, stable_round("threshold_high", 4).alias("threshold_high"), stable_round("threshold_suspect", 4).alias("threshold_suspect"))


@query("VRD-2", I.with_sql(THR_SQL, "SELECT match_id, steamid, suspicion_score FROM vd"))
def vrd2(spark, sf):
    return judged(spark, sf).select(*PLAYER, "suspicion_score")


@query("VRD-3", I.with_sql(THR_SQL, "SELECT match_id, steamid, verdict, len(factors) AS factors FROM vd"))
def vrd3(spark, sf):
    return judged(spark, sf).select(*PLAYER, "verdict", F.size("factors").cast("long").alias("factors"))


@query("VRD-4", I.with_sql(THR_SQL, """SELECT match_id, steamid, CASE WHEN CAST(substr(name, 2) AS BIGINT) % 7 = 0 THEN 'INSUFFICIENT_DATA' ELSE verdict END AS verdict,
  CASE WHEN CAST(substr(name, 2) AS BIGINT) % 7 = 0 THEN 'insufficient_data' ELSE 'ok' END AS analysis_status FROM vd"""))
def vrd4(spark, sf):
    gone = F.expr("cast(substring(name, 2) as bigint)") % 7 == 0
    m = I.scaled_metrics(spark, sf).withColumn("wh_ratio_lock_strict", F.when(~gone, F.col("wh_ratio_lock_strict")))
    return judge(m).select(*PLAYER, "verdict", "analysis_status")


@query("VRD-5", I.with_sql(THR_SQL, """SELECT match_id, steamid, round(100 - ml_score, 2) AS clean, round(ml_score, 2) AS suspicion, round(100 - ml_score, 2) AS clean_score,
  CASE WHEN ml_score >= 35 AND ml_score < 70 THEN ml_score ELSE 0 END AS suspect_score, CASE WHEN ml_score >= 70 THEN ml_score ELSE 0 END AS high_suspicion FROM vd"""))
def vrd5(spark, sf):
    d = I.scaled_metrics(spark, sf).select(*PLAYER, rules.score_map("ml_score").alias("s"))
    return d.select(*PLAYER, stable_round("s.clean", 2).alias("clean"), stable_round("s.suspicion", 2).alias("suspicion"),
                    stable_round("s.CLEAN_score", 2).alias("clean_score"), F.col("s.SUSPECT_score").alias("suspect_score"),
                    F.col("s.HIGH_SUSPICION").alias("high_suspicion"))


@query("VRD-6", I.with_sql(THR_SQL, """, b AS (SELECT *, CASE WHEN verdict = 'CHEATER' OR ml_score >= 80 THEN 'CHEATER' WHEN verdict = 'SUSPECT' OR ml_score >= 40 THEN 'SUSPECT' ELSE 'CLEAN' END AS band FROM vd)
  SELECT match_id, steamid, band, CASE band WHEN 'CHEATER' THEN 'SUSPICION ÉLEVÉE' WHEN 'SUSPECT' THEN 'COMPORTEMENT SUSPECT' ELSE 'NON DÉTECTÉ' END AS label,
  CASE WHEN ml_score < 40 THEN 'clean' WHEN ml_score < 80 THEN 'suspect' ELSE 'cheater' END AS colour FROM b"""))
def vrd6(spark, sf):
    d = judged(spark, sf).withColumn("band", rules.display_band("verdict", "ml_score"))
    return d.select(*PLAYER, "band", rules.band_label("band").alias("label"), rules.score_band("ml_score").alias("colour"))


CAT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(u, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules.CATEGORY_WORDS) + " ELSE 'other' END"


@query("CAT-1", I.with_sql(FLAGS_SQL, f""", x AS (SELECT match_id, steamid, unnest(pills || factors) AS flag FROM fl), y AS (SELECT *, upper(flag) AS u FROM x)
  SELECT match_id, steamid, flag, {CAT_SQL} AS category FROM y"""))
def cat1(spark, sf):
    return flagged(spark, sf).select(*PLAYER, F.explode(F.concat("pills", "factors")).alias("flag")).withColumn(
        "category", rules.flag_category(F.col("flag")))


def _card_sql():
    parts = []
    for name, crit, sus in rules.CARDS:
        def any_(groups):
            return " OR ".join("(" + " AND ".join(f"contains(u, '{w}')" for w in g) + ")" for g in groups) or "FALSE"
        parts.append(f"SELECT match_id, steamid, '{name}' AS card, CASE WHEN {any_(crit)} THEN 'critical' WHEN {any_(sus)} THEN 'suspect' ELSE 'conform' END AS state FROM u")
    return " UNION ALL ".join(parts)


@query("CAT-2", I.with_sql(FLAGS_SQL, f", u AS (SELECT match_id, steamid, upper(array_to_string(pills, ' ')) AS u FROM fl) {_card_sql()}"))
def cat2(spark, sf):
    return rules.diagnostics(flagged(spark, sf))


@query("CAT-3", I.with_sql(THR_SQL, f""", h AS (SELECT *, concat_ws(', ', CASE WHEN aim_p99 > 25 THEN 'Snap robotique violent de ' || {P99} || '°/tick' END,
    CASE WHEN wh_ratio_lock_strict * 100 > 10 THEN 'Tracking occlus (' || {STRICT} || '% locks à travers les murs)' END,
    CASE WHEN bhop_ratio_parfaits * 100 > 60 THEN 'Script de BunnyHop (' || {RAT0} || '% sauts parfaits en 1 tick)' END) AS hard,
    concat_ws(', ', CASE WHEN aim_p99 > 15 THEN 'Flick angulaire de ' || {P99} || '°/tick à la limite humaine' END,
    CASE WHEN bhop_chaine_max >= 3 THEN 'Chaîne de ' || {CHAIN} || ' sauts synchronisés' END) AS soft FROM vd)
  SELECT match_id, steamid, CASE verdict
    WHEN 'CHEATER' THEN CASE WHEN hard = '' AND len(factors) > 0 THEN array_to_string(factors[1:2], ' | ')
       ELSE 'Triche avérée : ' || CASE WHEN hard = '' THEN 'Anomalies biomécaniques multiples détectées.' ELSE hard END END
    WHEN 'SUSPECT' THEN 'Anomalies à vérifier : ' || CASE WHEN soft = '' THEN 'Mouvements atypiques au-dessus des moyennes pros.' ELSE soft END
    ELSE '✓ Visée humaine naturelle, accélération fluide, aucun lock à travers les murs ni script de saut.' END AS summary FROM h"""))
def cat3(spark, sf):
    return judged(spark, sf).select(*PLAYER, rules.verdict_summary().alias("summary"))


# --- aggregates --------------------------------------------------------------------------------------------------

@query("AGG-1", I.with_sql(I.BASE_SQL, "SELECT DISTINCT match_id, steamid FROM ticks WHERE steamid NOT IN ('', '0', 'Player_Unknown')"))
def agg1(spark, sf):
    return results.roster(I.ticks(spark, sf))


@query("AGG-2", I.with_sql(I.BASE_SQL, """, c AS (SELECT match_id, steamid, 2 + event_id % 2 AS team, count(*) AS n FROM ticks GROUP BY 1, 2, 3)
  SELECT match_id, steamid, CAST(arg_min(team, (-n, team)) AS INTEGER) AS team_number FROM c GROUP BY 1, 2"""))
def agg2(spark, sf):
    t = I.ticks(spark, sf).withColumn("team_num", (F.lit(2) + F.col("event_id") % 2).cast("int"))
    return results.main_team(t)


@query("AGG-3", I.with_sql(I.BASE_SQL, """, m AS (SELECT match_id, max(tick) - min(tick) + 1 AS total_ticks, CAST(substr(match_id, 2) AS BIGINT) AS k FROM ticks GROUP BY 1)
  SELECT match_id, total_ticks, round(CASE WHEN k % 3 = 1 THEN k * 1.5 ELSE total_ticks / 64 END, 6) AS duration_seconds FROM m"""))
def agg3(spark, sf):
    t = I.ticks(spark, sf)
    k = F.expr("cast(substring(match_id, 2) as bigint)")
    header = t.select("match_id").distinct().select("match_id", F.when(k % 3 == 1, k * 1.5).when(k % 3 == 2, 0.0).alias("playback_time"))
    return results.match_span(t, header).withColumn("duration_seconds", stable_round("duration_seconds", 6))


@query("AGG-4", I.with_sql(THR_SQL, """SELECT match_id, count(*) FILTER (verdict = 'CHEATER') AS cheaters, count(*) FILTER (verdict = 'SUSPECT') AS suspects,
  count(*) FILTER (verdict = 'CLEAN') AS clean, count(*) FILTER (verdict = 'ERROR') AS errors, count(*) FILTER (team_number = 3) AS ct,
  count(*) FILTER (team_number = 2) AS t, count(*) AS players FROM vd GROUP BY 1"""))
def agg4(spark, sf):
    return results.verdict_counts(judged(spark, sf))


MIXED = """, mx AS (SELECT *, CASE CAST(substr(name, 2) AS BIGINT) % 11 WHEN 3 THEN 'ERROR' WHEN 4 THEN 'SUSPECT' ELSE
    CASE WHEN CAST(substr(match_id, 2) AS BIGINT) % 3 = 0 THEN 'CLEAN' ELSE verdict END END AS v2 FROM vd)"""


def mixed(spark, sf):
    """Verdicts with errors and clean matches among them."""
    who, m = F.expr("cast(substring(name, 2) as bigint)") % 11, F.expr("cast(substring(match_id, 2) as bigint)") % 3
    return judged(spark, sf).withColumn("verdict", F.when(who == 3, "ERROR").when(who == 4, "SUSPECT").when(m == 0, "CLEAN").otherwise(F.col("verdict")))


@query("AGG-5", I.with_sql(THR_SQL, MIXED + """, c AS (SELECT match_id, count(*) FILTER (v2 = 'CHEATER') AS nc, count(*) FILTER (v2 = 'SUSPECT') AS ns, count(*) FILTER (v2 = 'ERROR') AS ne,
    array_to_string(list(name ORDER BY steamid) FILTER (v2 = 'CHEATER')[1:3], ', ') AS c3, array_to_string(list(name ORDER BY steamid) FILTER (v2 = 'SUSPECT')[1:3], ', ') AS s3 FROM mx GROUP BY 1),
  b AS (SELECT *, CASE WHEN nc > 0 THEN nc || ' SUSPICION(S) ÉLEVÉE(S) (' || c3 || ')' || CASE WHEN ns > 0 THEN ' | ' || ns || ' SUSPECT(S)' ELSE '' END
    WHEN ns > 0 THEN ns || ' JOUEUR(S) SUSPECT(S) (' || s3 || ')' ELSE 'AUCUN SIGNAL FORT DÉTECTÉ' END AS base FROM c)
  SELECT match_id, CASE WHEN ne = 0 THEN base WHEN nc > 0 OR ns > 0 THEN base || ' [MATCH INCOMPLET: ' || ne || ' ERREUR(S)]'
    ELSE 'MATCH INCOMPLET (' || ne || ' ERREUR(S) D''ANALYSE)' END AS global_verdict FROM b"""))
def agg5(spark, sf):
    return results.match_verdict(mixed(spark, sf)).select("match_id", "global_verdict")


# --- order and limit ---------------------------------------------------------------------------------------------

def _rank_sql(other):
    return I.with_sql(THR_SQL, MIXED + f"""SELECT match_id, steamid, v2 AS verdict, suspicion_score,
      CASE v2 WHEN 'CHEATER' THEN 0 WHEN 'SUSPECT' THEN 1 WHEN 'CLEAN' THEN 2 ELSE {other} END AS verdict_rank,
      row_number() OVER (ORDER BY CASE v2 WHEN 'CHEATER' THEN 0 WHEN 'SUSPECT' THEN 1 WHEN 'CLEAN' THEN 2 ELSE {other} END, suspicion_score DESC, match_id, steamid) AS position FROM mx""")


@query("SRT-1", _rank_sql(3))
def srt1(spark, sf):
    return results.with_position(results.rank_players(mixed(spark, sf), 3), 3).select(
        *PLAYER, "verdict", "suspicion_score", "verdict_rank", "position")


@query("SRT-2", _rank_sql(2))
def srt2(spark, sf):
    return results.with_position(results.rank_players(mixed(spark, sf), 2), 2).select(
        *PLAYER, "verdict", "suspicion_score", "verdict_rank", "position")


@query("SRT-3", "SELECT CAST(event_id AS VARCHAR) AS path, ts AS modified_time FROM events ORDER BY ts DESC, path LIMIT 50")
def srt3(spark, sf):
    d = I.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified_time"))
    return results.newest(d)


@query("SRT-4", I.with_sql(I.KIN_SQL, """, s AS (SELECT match_id, steamid, tick, round(raw_speed, 2) AS snap_angle FROM kin WHERE raw_speed > 18),
  k AS (SELECT *, row_number() OVER (PARTITION BY match_id, steamid ORDER BY snap_angle DESC, tick) AS n FROM s)
  SELECT match_id, steamid, tick, snap_angle FROM k WHERE n = 1 AND snap_angle >= 5"""))
def srt4(spark, sf):
    return results.worst_snap(aim.snap_events(I.ticks(spark, sf)))


TIMELINE_SQL = (
    I.KIN_SQL + I.bhop_ctes(False) + I.SPIN_CTES + I.occ_ctes().replace("error < 2.5", "error < 60") + I.trigger_ctes() + """,
occ_flagged AS (SELECT * FROM m_occ WHERE wh_ratio_lock_strict > 0.01 OR wh_tracking_consecutif_max >= 2),
span AS (SELECT match_id, steamid, min(tick) FILTER (NOT spotted) AS start_tick, max(tick) FILTER (NOT spotted) AS end_tick FROM pairs GROUP BY 1, 2),
evs AS (
  SELECT match_id, steamid, 'aim_snap' AS type, tick AS at_tick, NULL::BIGINT AS end_tick, '' AS reason, 1 AS kind FROM kin WHERE raw_speed > 18
  UNION ALL SELECT match_id, steamid, 'bhop_chain', start_tick, end_tick, '', 2 FROM runs JOIN m_bhop USING (match_id, steamid) WHERE run_len >= 4 AND bhop_chaine_max >= 4
  UNION ALL SELECT match_id, steamid, 'wh_lock', start_tick, end_tick, '', 3 FROM occ_flagged JOIN span USING (match_id, steamid) WHERE start_tick IS NOT NULL
  UNION ALL SELECT match_id, steamid, 'spinbot_detected', 0, NULL, '', 4 FROM m_spin WHERE spinbot_yaw_spin_windows > 0 OR spinbot_pitch_violations > 0
    OR spinbot_jitter_score > 2000 OR spinbot_desync_max_ticks >= 6
  UNION ALL SELECT match_id, steamid, 'triggerbot_event', 0, NULL, 'Anomalously fast median reaction time', 5 FROM m_trig
    WHERE triggerbot_total_shots_analyzed > 0 AND triggerbot_rt_median < 50
  UNION ALL SELECT match_id, steamid, 'triggerbot_event', 0, NULL, 'Statistically improbable consistency (std dev)', 5 FROM m_trig
    WHERE triggerbot_total_shots_analyzed >= 3 AND triggerbot_rt_std < 15
  UNION ALL SELECT match_id, steamid, 'triggerbot_event', 0, NULL, 'Sub-tick burst reaction pattern detected', 5 FROM m_trig
    WHERE triggerbot_total_shots_analyzed > 0 AND triggerbot_burst_count > 0),
tl AS (SELECT match_id, steamid, type, at_tick, row_number() OVER (PARTITION BY match_id, steamid ORDER BY at_tick, kind, end_tick, reason) AS seq FROM evs)
""")


def event_timeline(spark, sf):
    """All five kinds; locks with the wide angle of the lock queries."""
    from tickscope.plans.registry.detectors import LOOSE

    def build():
        t, k = I.ticks(spark, sf), I.kinematics(spark, sf)
        m = materialize(player_metrics(t, I.fires(t), cfg=LOOSE, radius=200.0, kin=k, detectors=("spin", "occlusion", "trigger")), "combat_metrics")
        return combat_events(t, I.fires(t), m, cfg=LOOSE, kin=k)

    return I.stored(spark, sf, "combat_events", build)


@query("SET-1", I.with_sql(TIMELINE_SQL, "SELECT match_id, steamid, type, at_tick, seq FROM tl"))
def set1(spark, sf):
    return event_timeline(spark, sf).select(*PLAYER, "type", "at_tick", "seq")


@query("SRT-5", I.with_sql(TIMELINE_SQL, "SELECT match_id, steamid, greatest(min(at_tick) - 350, 0) AS view_tick FROM tl GROUP BY 1, 2"))
def srt5(spark, sf):
    return results.earliest_view_tick(event_timeline(spark, sf))


@query("SRT-6", I.with_sql(TIMELINE_SQL, "SELECT match_id, steamid, type, at_tick, seq, seq <= 5 AS in_ticket FROM tl WHERE seq <= 8"))
def srt6(spark, sf):
    return results.first_events(event_timeline(spark, sf), 8).select(*PLAYER, "type", "at_tick", "seq", (F.col("seq") <= 5).alias("in_ticket"))


@query("SRT-7", """WITH r AS (SELECT user_id || '/' || day(ts) // 6 AS result_key, count(*) AS rows, max(ts) AS last_used FROM events GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY last_used DESC, result_key) <= 500 AS kept FROM r)
  SELECT result_key, kept, CASE WHEN kept THEN rows ELSE 0 END AS rows_on_disk, kept AS folder_there FROM o""")
def srt7(spark, sf):
    """Results by user and part of the month in a store; after retention 500 keys live, and the folders of the others are gone."""
    e = I.table(spark, sf, "events")
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.expr("cast(day(ts) div 6 as string)"))
    store = new_path(spark, "results")
    result_store.put(e.select(key.alias("result_key"), F.col("ts").cast("timestamp").alias("last_used"), "event_id"), store)
    result_store.evict(spark, store)
    result_store.purge(spark, store)
    left = result_store.data(spark, store).groupBy("result_key").agg(F.count(F.lit(1)).alias("rows_on_disk"))
    folders = result_store.stored_folders(spark, store).select("result_key", F.lit(True).alias("folder_there"))
    live = result_store.live_keys(spark, store).select("result_key", F.lit(True).alias("kept"))
    every = e.select(key.alias("result_key")).distinct()
    for part in (live, left, folders):
        every = every.join(part, "result_key", "left")
    return every.select("result_key", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("kept", "folder_there")], F.coalesce("rows_on_disk", F.lit(0)).alias("rows_on_disk"))


# --- sets and joins ----------------------------------------------------------------------------------------------

def splits(spark, sf):
    """Player rows of events with a split by match and a few leaks on purpose."""
    t = I.ticks(spark, sf)
    s = F.expr("cast(substring(match_id, 2) as bigint)") % 3
    leak = (F.col("event_id") % 97 == 0)
    return t.select(*PLAYER, F.when(leak, "test").when(s == 0, "train").when(s == 1, "validation").otherwise("test").alias("split"))


@query("SET-2", I.with_sql(I.BASE_SQL, """, k AS (SELECT DISTINCT match_id || ':' || steamid AS k, CASE WHEN event_id % 97 = 0 THEN 'test'
    ELSE CASE CAST(substr(match_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END END AS split FROM ticks),
  n AS (SELECT a.split AS x, b.split AS y, count(*) AS c FROM k a JOIN k b USING (k) GROUP BY 1, 2)
  SELECT coalesce(sum(c) FILTER (x = 'train' AND y = 'validation'), 0)::BIGINT AS train_validation, coalesce(sum(c) FILTER (x = 'train' AND y = 'test'), 0)::BIGINT AS train_test,
    coalesce(sum(c) FILTER (x = 'validation' AND y = 'test'), 0)::BIGINT AS validation_test FROM n"""))
def set2(spark, sf):
    return results.leakage_by_pair(splits(spark, sf))


@query("SET-4", I.with_sql(I.BASE_SQL, """, k AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'test'
    ELSE CASE CAST(substr(match_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END END AS split FROM ticks)
  SELECT split, count(*) AS rows FROM k GROUP BY 1"""))
def set4(spark, sf):
    d = splits(spark, sf)
    parts = [d.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("JOIN-5", I.with_sql(I.BASE_SQL, """, ros AS (SELECT DISTINCT match_id, steamid, name FROM ticks),
  q AS (SELECT event_id, match_id, CASE event_id % 3 WHEN 0 THEN steamid WHEN 1 THEN name ELSE 'ghost' END AS identifier FROM ticks)
  SELECT q.event_id, coalesce(a.name, b.name, identifier) AS resolved_name, coalesce(a.steamid, b.steamid) AS resolved_steamid FROM q
  LEFT JOIN ros a ON q.match_id = a.match_id AND q.identifier = a.steamid LEFT JOIN ros b ON q.match_id = b.match_id AND q.identifier = b.name"""))
def join5(spark, sf):
    t = I.ticks(spark, sf)
    who = F.when(F.col("event_id") % 3 == 0, F.col("steamid")).when(F.col("event_id") % 3 == 1, F.col("name")).otherwise("ghost")
    refs = t.select("event_id", "match_id", who.alias("identifier"))
    return results.resolve_players(refs, results.players(t)).select("event_id", "resolved_name", "resolved_steamid")


@query("JOIN-9", """WITH c AS (SELECT event_id, sha256(concat_ws('|', '2.5.2', '1.0', 'fp', '/replays/' || CAST(event_id AS VARCHAR) || '.dem',
    CAST(length(props) AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))) AS h FROM events)
  SELECT event_id, substr(h, 1, 32) AS fingerprint FROM c WHERE event_id % 3 <> 0""")
def join9(spark, sf):
    files = I.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("/replays/"), F.col("event_id").cast("string"), F.lit(".dem")).alias("path"),
        F.length("props").alias("length"), F.col("ts").alias("modified_time"))
    keyed = results.match_fingerprint(files, "fp")
    return results.not_yet_analysed(keyed, keyed.where("event_id % 3 = 0")).select("event_id", "fingerprint")


# --- reports -----------------------------------------------------------------------------------------------------

def _values_sql():
    def pct(c):
        return f"CASE WHEN {c} > 0 AND {c} <= 1 THEN {c} * 100 ELSE {c} END"
    return {
        "name": "name", "steamid": "steamid", "verdict": "verdict", "score": f1("suspicion_score"), "map": "'Inconnue'",
        "demo": "'demo_inconnue.dem'", "p99": f1("aim_p99"), "speed_max": f1("aim_vitesse_max"), "jerk_max": f1("aim_jerk_max"),
        "jerk_mean": f1("aim_jerk_moyen"), "ratio": f1(pct("bhop_ratio_parfaits")), "jumps": n0("bhop_total_sauts"), "chain": n0("bhop_chaine_max"),
        "jump_speed": f1("bhop_vitesse_moyenne"), "strict": f1(pct("wh_ratio_lock_strict")), "wide": f1(pct("wh_ratio_lock_cache")),
        "run": n0("wh_tracking_consecutif_max"), "distance": f1("wh_distance_moyenne_verrous"),
        "steam_url": "CASE WHEN regexp_full_match(steamid, '[0-9]{17}') THEN 'https://steamcommunity.com/profiles/' || steamid ELSE '' END",
        "faceit_url": "CASE WHEN regexp_full_match(steamid, '[0-9]{17}') THEN 'https://faceitfinder.com/profile/' || steamid ELSE '' END",
    }


def _quote(s):
    return "'" + s.replace("'", "''") + "'"


def _template_sql(template, values):
    import re
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else _quote(p) for i, p in enumerate(parts) if p)


def _lines_sql(lines):
    v = {"tick": "CAST(tick AS VARCHAR)", "snap": f1("snap_angle"), "jerk": f1("jerk"), "weapon": "weapon", "start": "CAST(start_tick AS VARCHAR)",
         "end": "CAST(end_tick AS VARCHAR)", "length": "CAST(chain_length AS VARCHAR)", "speed": f1("avg_speed"), "type": "type",
         "target": "target_name", "duration": "CAST(duration_ticks AS VARCHAR)", "distance": f1("distance")}
    cases = " ".join(f"WHEN type = '{k}' THEN {_template_sql(t, v)}" for k, t in lines.items() if k)
    tail = f" ELSE {_template_sql(lines[None], v)}" if None in lines else ""
    return f"CASE {cases}{tail} END"


def _bullets_sql(c, bullet, empty):
    return f"CASE WHEN len({c}) > 0 THEN array_to_string(list_transform({c}, lambda x: {_quote(bullet)} || x), chr(10)) ELSE {_quote(empty)} END"


REPORT_CTES = THR_SQL + """,
rep_ev AS (
  SELECT match_id, steamid, 'aim_snap' AS type, tick, NULL::BIGINT AS start_tick, NULL::BIGINT AS end_tick, round(raw_speed, 2) AS snap_angle,
         round(raw_jerk, 2) AS jerk, active_weapon_name AS weapon, NULL::BIGINT AS chain_length, NULL::DOUBLE AS avg_speed, NULL::BIGINT AS duration_ticks,
         NULL::VARCHAR AS target_name, NULL::DOUBLE AS distance FROM kin WHERE raw_speed > 120
  UNION ALL SELECT match_id, steamid, 'bhop_chain', NULL, start_tick, end_tick, NULL, NULL, NULL, run_len, round(m.bhop_vitesse_moyenne, 2), NULL, NULL, NULL
    FROM runs JOIN m_bhop m USING (match_id, steamid) WHERE run_len >= 2 AND m.bhop_chaine_max >= 2
  UNION ALL SELECT match_id, steamid, 'spinbot_detected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m_spin
    WHERE spinbot_yaw_spin_windows > 0 OR spinbot_pitch_violations > 0 OR spinbot_jitter_score > 2000 OR spinbot_desync_max_ticks >= 6),
rep_seq AS (SELECT *, row_number() OVER (PARTITION BY match_id, steamid ORDER BY coalesce(tick, start_tick, 0),
    CASE type WHEN 'aim_snap' THEN 1 WHEN 'bhop_chain' THEN 2 ELSE 4 END, end_tick) AS seq FROM rep_ev)
"""


def report_events(spark, sf):
    """Wide snaps only, chains of two, spin events: every kind is among the first of some player."""
    from dataclasses import replace

    def build():
        k = I.kinematics(spark, sf)
        return results.event_timeline(
            aim.snap_events_of(k, replace(RULE_CFG, snap_threshold=120.0)), bhop.chain_events_of(bhop.jump_rows_of(k), replace(RULE_CFG, chain_event=2), materialize),
            spin.spin_events(I.metrics(spark, sf)))

    return I.stored(spark, sf, "report_events", build)


def _report_sql(template, n, lines, head, none, extra):
    values = _values_sql() | {"events": f"CASE WHEN lines IS NULL THEN {_quote(none)} ELSE {_quote(head)} || lines END"} | extra
    return I.with_sql(REPORT_CTES, f""", rl AS (SELECT match_id, steamid, seq, {_lines_sql(lines)} AS line FROM rep_seq WHERE seq <= {n}),
      lg AS (SELECT match_id, steamid, string_agg(line, chr(10) ORDER BY seq) AS lines FROM rl WHERE line IS NOT NULL GROUP BY 1, 2)
      SELECT match_id, steamid, {_template_sql(template, values)} AS report FROM vd LEFT JOIN lg USING (match_id, steamid)""")


@query("RPT-1", _report_sql(reports.PROOF, 8, reports.PROOF_LINES, reports.PROOF_EVENTS, reports.PROOF_NO_EVENTS, {}))
def rpt1(spark, sf):
    return reports.telemetry_proof(judged(spark, sf), report_events(spark, sf)).select(*PLAYER, "report")


SEEN = "Followed opponents through the smoke twice"


def _ticket_extra(empty, bullet):
    return {"flags": _bullets_sql("factors", bullet, empty["flags"]), "observations": _quote("• " + SEEN),
            "comment": f"CASE WHEN ml_score > 50 THEN 'vu en direct' ELSE {_quote(empty['comment'])} END", "generator": "'tickscope'"}


def _ticket_players(spark, sf):
    return judged(spark, sf).withColumns({
        "observations": F.array(F.lit(SEEN)), "comment": F.when(F.col("ml_score") > 50, " vu en direct ").otherwise("")})


@query("RPT-2", _report_sql(reports.TICKET_FR, 5, reports.TICKET_FR_LINES, reports.TICKET_FR_EVENTS, "", _ticket_extra(reports.TICKET_FR_EMPTY, "  • ")))
def rpt2(spark, sf):
    return reports.ticket_fr(_ticket_players(spark, sf), report_events(spark, sf)).select(*PLAYER, "report")


@query("RPT-3", _report_sql(reports.TICKET_EN, 5, reports.TICKET_EN_LINES, reports.TICKET_EN_EVENTS, "", _ticket_extra(reports.TICKET_EN_EMPTY, "• ")))
def rpt3(spark, sf):
    return reports.ticket_en(_ticket_players(spark, sf), report_events(spark, sf)).select(*PLAYER, "report")


@query("RPT-4", I.with_sql(THR_SQL, f"""SELECT match_id, steamid, {_template_sql(reports.DIAGNOSTIC, _values_sql() | {
    "title": "'TELEMETRY'", "date": "'2024-01-31 00:00:00'", "flags": _bullets_sql("factors", "  > ", reports.DIAGNOSTIC_EMPTY)})} AS report FROM vd"""))
def rpt4(spark, sf):
    return reports.diagnostic(judged(spark, sf), F.lit("2024-01-31 00:00:00")).select(*PLAYER, "report")


@query("RPT-5", I.with_sql(THR_SQL, """, m AS (SELECT match_id, max(tick) - min(tick) + 1 AS n FROM ticks GROUP BY 1), c AS (SELECT match_id, count(*) AS p,
    count(*) FILTER (verdict = 'CHEATER') AS nc, count(*) FILTER (verdict = 'SUSPECT') AS ns,
    array_to_string(list(name ORDER BY steamid) FILTER (verdict = 'CHEATER')[1:3], ', ') AS c3, array_to_string(list(name ORDER BY steamid) FILTER (verdict = 'SUSPECT')[1:3], ', ') AS s3 FROM vd GROUP BY 1)
  SELECT match_id, 0 AS part, '' AS steamid, 'Carte: None | Ticks: ' || n || ' | Joueurs: ' || p AS line FROM c JOIN m USING (match_id)
  UNION ALL SELECT match_id, 1, steamid, '  ' || name || ' [' || steamid || '] ' || verdict || ' ' || printf('%.1f', suspicion_score) || '% - ' || array_to_string(factors, '; ') FROM vd
  UNION ALL SELECT match_id, 2, '', 'Verdict global: ' || CASE WHEN nc > 0 THEN nc || ' SUSPICION(S) ÉLEVÉE(S) (' || c3 || ')' || CASE WHEN ns > 0 THEN ' | ' || ns || ' SUSPECT(S)' ELSE '' END
    WHEN ns > 0 THEN ns || ' JOUEUR(S) SUSPECT(S) (' || s3 || ')' ELSE 'AUCUN SIGNAL FORT DÉTECTÉ' END FROM c"""))
def rpt5(spark, sf):
    p = judged(spark, sf)
    m = results.match_verdict(p).join(results.match_span(I.ticks(spark, sf)), "match_id")
    return reports.match_lines(p, m)
