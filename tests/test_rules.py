"""Rules, score, verdict, categories, reports, match verdict."""

import pytest
from conftest import one
from pyspark.sql import functions as F

from tickscope.functions import text
from tickscope.operators import reports, results, rules

ZERO = dict(aim_vitesse_max=1.0, aim_p99=1.0, aim_jerk_moyen=0.0, aim_jerk_max=1.0, bhop_total_sauts=0.0, bhop_ratio_parfaits=0.0,
            bhop_chaine_max=0.0, bhop_vitesse_moyenne=0.0, wh_ratio_lock_cache=0.0, wh_ratio_lock_strict=0.0, wh_tracking_consecutif_max=0.0,
            wh_distance_moyenne_verrous=0.0, spinbot_yaw_speed_max=0.0, spinbot_yaw_spin_windows=0, spinbot_pitch_violations=0,
            spinbot_jitter_score=0.0, spinbot_desync_max_ticks=0, triggerbot_rt_median=0.0, triggerbot_rt_std=0.0,
            triggerbot_burst_count=0, triggerbot_total_shots_analyzed=0, ml_score=0.0)


def judge(spark, model=None, **kw):
    row = {"match_id": "m", "steamid": "76561198000000001", "name": "x"} | ZERO | kw
    d = spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in ({"match_id": "", "steamid": "", "name": ""} | ZERO).items()))
    d = rules.with_thresholds(rules.with_flags(d), model)
    return rules.normalize_result(rules.with_verdict(rules.with_score(d)))


@pytest.mark.parametrize("kw,pill", [
    (dict(aim_p99=25.0), "[AIMBOT: Snap 25.0°/tick]"), (dict(aim_jerk_max=48.0), "[AIMBOT: Jerk 48.0]"),
    (dict(bhop_ratio_parfaits=0.75, bhop_total_sauts=20.0), "[BHOP: Script 75%]"), (dict(bhop_chaine_max=5.0), "[BHOP: Chaîne x5]"),
    (dict(wh_ratio_lock_strict=0.18, wh_tracking_consecutif_max=85.0), "[WALLHACK: 18.0% Lock Mur]"),
    (dict(wh_tracking_consecutif_max=195.0), "[INFO-ESP: Track 195 ticks]"), (dict(spinbot_desync_max_ticks=6), "[ANTI-AIM: Flip 6t]"),
    (dict(spinbot_jitter_score=2001.0), "[ANTI-AIM: Jitter]"),
    (dict(triggerbot_total_shots_analyzed=3, triggerbot_rt_median=31.25, triggerbot_rt_std=20.0), "[TRIGGERBOT: Réaction 31ms]"),
])
def test_one_rule_is_suspect(spark, kw, pill):
    r = one(judge(spark, **kw))
    assert pill in r["pills"] and len(r["factors"]) == 1
    assert r["verdict"] == "SUSPECT" and 40 <= r["suspicion_score"] < 80


def test_many_rules_are_a_cheater(spark):
    r = one(judge(spark, aim_p99=25.0, aim_jerk_max=60.0, bhop_chaine_max=5.0))
    assert r["verdict"] == "CHEATER" and r["suspicion_score"] == 80.0 and len(r["factors"]) == 3


@pytest.mark.parametrize("kw", [dict(spinbot_yaw_spin_windows=1), dict(spinbot_pitch_violations=1)])
def test_rage(spark, kw):
    r = one(judge(spark, **kw))
    assert r["verdict"] == "CHEATER" and r["suspicion_score"] == 90.0


def test_no_rule(spark):
    assert one(judge(spark, ml_score=30.0))["verdict"] == "CLEAN"
    assert one(judge(spark, ml_score=65.0))["verdict"] == "SUSPECT"
    assert one(judge(spark, ml_score=85.0))["verdict"] == "CHEATER"


def test_inactive_player_is_clean(spark):
    r = one(judge(spark, ml_score=50.0, aim_vitesse_max=0.0, aim_p99=0.0, aim_jerk_max=0.0))
    assert r["verdict"] == "CLEAN" and r["suspicion_score"] == 5.0


def test_model_thresholds(spark):
    model = spark.createDataFrame([(0.5, None, 0.3)], "threshold double, threshold_high double, threshold_suspect double")
    r = one(judge(spark, model, ml_score=50.0))
    assert r["verdict"] == "CHEATER" and r["threshold_high"] == 50.0 and r["threshold_suspect"] == 30.0


def test_unknown_score_is_never_clean(spark):
    base = dict(aim_vitesse_max=1.0, aim_p99=1.0, bhop_total_sauts=0, wh_ratio_lock_strict=0.0, rage=False, threshold_high=80.0, threshold_suspect=60.0)
    rows = [(i, s, f, *base.values()) for i, (s, f) in enumerate([(None, []), (float("nan"), []), (None, ["x"]), (10.0, [])])]
    d = spark.createDataFrame(rows, "i int, ml_score double, factors array<string>, aim_vitesse_max double, aim_p99 double, bhop_total_sauts int, wh_ratio_lock_strict double, rage boolean, threshold_high double, threshold_suspect double")
    got = {r.i: r.verdict for r in rules.normalize_result(rules.with_verdict(rules.with_score(d))).collect()}
    assert got == {0: "INSUFFICIENT_DATA", 1: "INSUFFICIENT_DATA", 2: "SUSPECT", 3: "CLEAN"}


def test_missing_profile_is_never_clean(spark):
    r = one(judge(spark, aim_p99=None))
    assert (r["verdict"], r["analysis_status"], r["data_quality"]) == ("INSUFFICIENT_DATA", "insufficient_data", "insufficient")


@pytest.mark.parametrize("flag,cat", [("AIMBOT: Snap", "aim"), ("[INFO-ESP: Track 9 ticks]", "esp"), ("Sauts", "bhop"), ("Pitch", "spin"),
                                      ("Réaction 20ms", "trigger"), ("critique", "critical"), ("x", "other")])
def test_category(spark, flag, cat):
    assert spark.range(1).select(rules.flag_category(F.lit(flag)).alias("c")).first()["c"] == cat


def test_fixed_decimals_like_printf(spark):
    for x in (0.25, 0.35, 2.675, 12.25, 31.25, 1234567.85, -0.05, 25.15):
        assert spark.range(1).select(text.fixed(F.lit(x)).alias("c")).first()["c"] == f"{x:.1f}"


def test_names_and_sizes(spark):
    f = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert f(text.safe_file_name(F.lit('a/b:c*?"<>|'))) == "abc" and f(text.safe_file_name(F.lit("??"))) == "Joueur_Inconnu"
    assert f(text.readable_size(F.lit(500))) == "500 B" and f(text.readable_size(F.lit(1536))) == "1.5 KB"
    assert f(text.readable_size(F.lit(3 * 1024**3))) == "3.00 GB"
    assert f(text.profile_url(F.lit(" 76561198000000001 "))).endswith("/76561198000000001") and f(text.profile_url(F.lit("BOT"))) == ""
    assert f(text.duration_label(F.lit(984.5))) == "16m 24s"


def test_match_verdict(spark):
    rows = [("m1", f"s{i}", f"n{i}", "CHEATER" if i < 4 else "SUSPECT" if i < 5 else "ERROR", 2) for i in range(6)]
    rows += [("m2", "a", "a", "CLEAN", 3), ("m3", "a", "a", "ERROR", 3), ("m3", "b", "b", "CLEAN", 2)]
    d = spark.createDataFrame(rows, "match_id string, steamid string, name string, verdict string, team_number int")
    got = {r.match_id: r.global_verdict for r in results.match_verdict(d).collect()}
    assert got == {"m1": "4 SUSPICION(S) ÉLEVÉE(S) (n0, n1, n2) | 1 SUSPECT(S) [MATCH INCOMPLET: 1 ERREUR(S)]",
                   "m2": "AUCUN SIGNAL FORT DÉTECTÉ", "m3": "MATCH INCOMPLET (1 ERREUR(S) D'ANALYSE)"}


def test_reports(spark):
    p = judge(spark, aim_p99=25.0)
    ev = spark.createDataFrame([("m", "76561198000000001", "aim_snap", i, 20.25, 3.0, "ak", i) for i in range(1, 11)],
                               "match_id string, steamid string, type string, tick long, snap_angle double, jerk double, weapon string, seq long")
    for c, t in results.EVENT_SCHEMA.items():
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast(t))
    proof = one(reports.telemetry_proof(p, ev))["report"]
    assert proof.count("SNAP DE VISÉE") == 8 and "[Tick 1] SNAP DE VISÉE : 20.2°/tick" in proof
    fr, en = one(reports.ticket_fr(p, ev))["report"], one(reports.ticket_en(p, ev))["report"]
    assert fr.count("- Tick ") == 5 and "Snap instantané anormal (25.0°/tick)" in fr
    assert "None provided." in en and "FaceitFinder: https://" in en
    none = one(reports.telemetry_proof(p, ev.where("false")))["report"]
    assert none.endswith(reports.PROOF_NO_EVENTS)
