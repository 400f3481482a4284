"""Detectors on small hand-made timelines with known results."""

from dataclasses import replace

import numpy as np
import pytest
from conftest import one
from pyspark.sql import functions as F

from tickscope.config import DEFAULT
from tickscope.functions import angles
from tickscope.operators import aim, bhop, occlusion, spin, trigger


@pytest.mark.parametrize("a,b,want", [(179, -179, 2), (-179, 179, -2), (179.9, -179.9, 0.2), (0, 270, -90), (0, 725, 5), (0, -715, 5)])
def test_wrap(spark, a, b, want):
    got = spark.range(1).select(angles.angular_delta(float(a), float(b)).alias("d")).first()["d"]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("a,want", [(270, -90), (-280, 80), (360, 0), (720, 0)])
def test_normalize(spark, a, want):
    assert spark.range(1).select(angles.normalize_angle(float(a)).alias("d")).first()["d"] == pytest.approx(want)


@pytest.mark.parametrize("yaw,before", [(-172.96000000000004, 7.039999999999992), (-120.46000000000004, 59.53999999999999), (-180.0, 0.0), (170.0, -10.0), (0.1, 0.3)])
def test_half_turns_have_the_sign_of_python(spark, yaw, before):
    """A half turn with the noise of doubles: the sign decides direction changes."""
    got = spark.createDataFrame([(before, yaw)], "a double, b double").select(angles.angular_delta("a", "b").alias("d")).first()["d"]
    assert got == (yaw - before + 180.0) % 360.0 - 180.0


@pytest.mark.parametrize("e,want", [((100, 0, 2), (0, 0, 100.02)), ((0, 100, 2), (90, 0, 100.02)), ((0, 0, 2), (0, 0, 0)), ((0, 0, 50), (0, -88.854, 50))])
def test_aim_angles(spark, e, want):
    r = spark.range(1).select(angles.aim_angles_3d(0.0, 0.0, 0.0, *map(float, e)).alias("a")).first()["a"]
    assert tuple(r) == pytest.approx(want, abs=0.01)


# --- aim ---------------------------------------------------------------------------------------------------------

def test_smooth_aim(make, shots):
    t = make(dict(n=100, yaw=[0.2 * i for i in range(100)], pitch=[0.1 * i for i in range(100)]))
    m = one(aim.aim_metrics(t, shots([1020, 1050])))
    assert m["aim_p99"] == pytest.approx(0.2236, abs=1e-4) and m["aim_jerk_max"] < 0.3
    assert aim.snap_events(t).count() == 0


def test_snap(make, shots):
    t = make(dict(n=60, yaw=[45.0 if i == 20 else 10.0 for i in range(60)]))
    m = one(aim.aim_metrics(t, shots([1020])))
    assert m["aim_p99"] > 18 and m["aim_vitesse_max"] == 35.0
    # speed 0 35 35 0, acceleration 35 0 35, jerk 35 35 35 35
    assert m["aim_jerk_max"] == 35.0
    ev = aim.snap_events(t).orderBy("tick").collect()
    assert [e.tick for e in ev] == [1020, 1021]
    assert [p.tick for p in ev[0].trajectory] == list(range(1017, 1024))


def test_many_turns(make, shots):
    t = make(dict(n=40, yaw=[810.0 if i == 20 else 0.0 for i in range(40)]))
    assert one(aim.aim_metrics(t, shots([])))["aim_p99"] == 90.0


def test_gap_has_no_speed(make, shots):
    t = make(dict(n=25, tick=[10 * i for i in range(25)], yaw=[float(30 * i) for i in range(25)]))
    assert one(aim.aim_metrics(t, shots([])))["aim_vitesse_max"] == 0.0
    assert aim.snap_events(t).count() == 24  # events do not ask for contiguous ticks


def test_too_few_rows(make, shots):
    m = one(aim.aim_metrics(make(dict(n=19, yaw=[50.0 * i for i in range(19)])), shots([])))
    assert set(v for k, v in m.items() if k.startswith("aim_")) == {0.0}


def test_shot_window_is_used_if_large_enough(make, shots):
    # the only movement is far from the shot
    t = make(dict(n=200, yaw=[90.0 if i == 150 else 0.0 for i in range(200)]))
    assert one(aim.aim_metrics(t, shots([1020])))["aim_vitesse_max"] == 0.0
    assert one(aim.aim_metrics(t, shots([])))["aim_vitesse_max"] == 90.0


def test_quadratic_path_fits(make, shots):
    # 24 rows: the block that would start at 16 is left out, two blocks of a parabola fit exactly
    t = make(dict(n=24, yaw=[0.05 * i * i for i in range(24)]))
    assert one(aim.aim_metrics(t, shots([])))["aim_fit_polynomial_indicatif"] == pytest.approx(1.0)


def test_lock_after_snap(make, shots):
    t = make(dict(n=30, yaw=[0.0 if i < 10 else 20.0 for i in range(30)]))
    m = one(aim.aim_metrics(t, shots([])))
    assert m["aim_fov_lock_ratio"] == 1.0 and m["aim_vitesse_acquisition"] == 20.0


# --- jumps -------------------------------------------------------------------------------------------------------

def pattern(*parts):
    return [state for state, n in parts for _ in range(n)]


def jumps(make, air, **kw):
    return make(dict(n=len(air), is_airborne=air, velocity_X=280.0, **kw))


def test_human_jumps(make):
    air = pattern((False, 5), *[(True, 10), (False, 10)] * 4)
    m = one(bhop.bhop_metrics(jumps(make, air)))
    assert m["bhop_ratio_parfaits"] == 0.0 and m["bhop_chaine_max"] == 0.0 and m["bhop_total_sauts"] == 4.0


@pytest.mark.parametrize("profile", ["tabular", "replay"])
def test_scripted_jumps(make, profile):
    air = pattern((False, 2), *[(True, 8), (False, 1)] * 5, (True, 8), (False, 10))
    m = one(bhop.bhop_metrics(jumps(make, air), profile=profile))
    assert m["bhop_ratio_parfaits"] == 1.0 and m["bhop_chaine_max"] == 5.0 and m["bhop_vitesse_moyenne"] == 280.0


def test_chain_event(make):
    air = pattern((False, 2), *[(True, 8), (False, 1)] * 5, (True, 8), (False, 10))
    e = one(bhop.chain_events(jumps(make, air)))
    assert (e["start_tick"], e["end_tick"], e["chain_length"], e["avg_speed"]) == (1010, 1047, 5, 280.0)


def test_two_tick_landing_is_human(make):
    air = pattern((False, 5), *[(True, 12), (False, 2)] * 6, (True, 12), (False, 10))
    t = jumps(make, air)
    m = one(bhop.bhop_metrics(t))
    assert m["bhop_ratio_parfaits"] == 0.0 and m["bhop_chaine_max"] == 0.0
    assert bhop.chain_events(t).count() == 0


@pytest.mark.parametrize("state", [True, False])
def test_one_state_only(make, state):
    m = one(bhop.bhop_metrics(jumps(make, [state] * 200)))
    assert m["bhop_total_sauts"] == 0.0 and m["bhop_variance_sol"] == 50.0


def test_strafe_with_constant_side(make):
    air = pattern((False, 2), *[(True, 20), (False, 5)] * 3)
    m = one(bhop.bhop_metrics(jumps(make, air, yaw=[float(i) for i in range(len(air))]), profile="replay"))
    assert m["bhop_autostrafe_correlation"] == 0.0


def test_strafe_in_step(make):
    import math
    air = pattern((False, 2), *[(True, 20), (False, 5)] * 3)
    turn = [(i * i % 23) * 0.5 for i in range(len(air))]
    t = make(dict(n=len(air), is_airborne=air, yaw=turn, velocity_X=[100 * math.cos(math.radians(y)) for y in turn],
                  velocity_Y=[100 * math.sin(math.radians(y)) for y in turn]))
    assert one(bhop.bhop_metrics(t, profile="replay"))["bhop_autostrafe_correlation"] == pytest.approx(1.0)


# --- spin --------------------------------------------------------------------------------------------------------

def test_spin(make):
    m = one(spin.spin_metrics(make(dict(n=60, yaw=[(120 * i) % 360 - 180.0 for i in range(60)]))))
    # 45 full windows; the first holds the first row, which has no step: mean 112.5
    assert m["spinbot_yaw_speed_max"] == 120.0 and m["spinbot_yaw_spin_windows"] == 45


def test_pitch_violations(make):
    m = spin.spin_metrics(make(dict(n=40, pitch=[{5: 120.0, 6: -120.0, 9: 180.0}.get(i, 0.0) for i in range(40)])))
    assert one(m)["spinbot_pitch_violations"] == 3
    assert one(spin.spin_events(m))["type"] == "spinbot_detected"


def test_flips(make):
    yaw = [(-1) ** i * 85.0 if 10 <= i < 20 else 85.0 for i in range(40)]
    assert one(spin.spin_metrics(make(dict(n=40, yaw=yaw))))["spinbot_desync_max_ticks"] == 10


def test_short_series(make):
    m = one(spin.spin_metrics(make(dict(n=2, yaw=[0.0, 170.0]))))
    assert m["spinbot_yaw_speed_max"] == 0.0


# --- occlusion ---------------------------------------------------------------------------------------------------

def duel(make, n=80, **enemy):
    me = dict(n=n, steamid="a", team_num=3, yaw=[0.2 if i % 2 == 0 else -0.2 for i in range(n)])
    return make(me, dict(n=n, steamid="b", name="Victim", X=500.0, Z=2.0, yaw=180.0) | enemy)


def test_occluded_lock(make):
    t = duel(make)
    m = {r.steamid: r.asDict() for r in occlusion.occlusion_metrics(t).collect()}
    assert m["a"]["wh_ratio_lock_strict"] == 1.0 and m["a"]["wh_tracking_consecutif_max"] == 80.0
    e = {r.steamid: r for r in occlusion.lock_events(t, occlusion.occlusion_metrics(t)).collect()}
    assert (e["a"].target_steamid, e["a"].target_name, e["a"].start_tick, e["a"].end_tick) == ("b", "Victim", 1000, 1079)


@pytest.mark.parametrize("seen", [True, None])
def test_visible_or_unknown_is_ignored(make, seen):
    m = [r for r in occlusion.occlusion_metrics(duel(make, spotted=seen)).collect() if r.steamid == "a"][0]
    assert m.wh_ratio_lock_strict == 0.0 and m.wh_tracking_consecutif_max == 0.0


def test_range_edges(make):
    x = [199.9] * 30 + [200.0] * 30 + [2000.0] * 30 + [2000.1] * 30
    m = [r for r in occlusion.occlusion_metrics(duel(make, n=120, X=x, Z=0.0)).collect() if r.steamid == "a"][0]
    assert m.wh_ratio_lock_strict == 0.5


def test_side_swap(make):
    half = [3] * 40 + [2] * 40
    t = duel(make, team_num=[2] * 80).where("steamid = 'b'").union(duel(make).where("steamid = 'a'").withColumn(
        "team_num", F.when(F.col("tick") < 1040, 3).otherwise(2)))
    a = lambda **kw: [r for r in occlusion.occlusion_metrics(t, **kw).collect() if r.steamid == "a"][0].wh_ratio_lock_strict
    assert a() == 0.5 and a(team_mode="first") == 1.0 and len(half) == 80


def test_crowded_match_uses_cells(make, spark):
    t = duel(make)
    plain, cells = (occlusion.sight_pairs(t, replace(DEFAULT, crowd=c)).select("tick", "steamid", "target", "error").collect() for c in (10**9, 1))
    assert sorted(plain) == sorted(cells) and len(plain) > 0


def test_two_thousand_players_on_one_tick(spark):
    rows = spark.range(2000).selectExpr("'m' as match_id", "cast(id as string) as steamid", "cast(id as string) as name", "1L as tick", "cast(id * 700 as double) as X",
                                        "0.0D as Y", "0.0D as Z", "0.0D as pitch", "0.0D as yaw", "cast(2 + id % 2 as int) as team_num", "100 as health", "false as spotted")
    plain, cells = (occlusion.sight_pairs(rows, replace(DEFAULT, crowd=c)).select("steamid", "target", "distance", "error").collect() for c in (10**9, 64))
    assert sorted(plain) == sorted(cells) and len(plain) == 2 * (1999)


def test_first_opponent_is_that_of_the_match(make):
    t = make(dict(n=80, steamid="z", X=9000.0, start=900), dict(n=80, steamid="a", team_num=3), dict(n=80, steamid="b", X=500.0, Z=2.0))
    ev = occlusion.lock_events(t, occlusion.occlusion_metrics(t)).where("steamid = 'a'").collect()
    assert [(r.target_steamid, r.start_tick, r.end_tick) for r in ev] == [("z", 1000, 1079)]


def test_active_tracking_needs_movement(make):
    t = duel(make)
    still = make(dict(n=80, steamid="a", team_num=3), dict(n=80, steamid="b", X=500.0, Z=2.0))
    run = lambda d: [r for r in occlusion.occlusion_metrics(d, profile="replay").collect() if r.steamid == "a"][0]
    assert run(t).wh_tracking_consecutif_max == 79.0  # the first lock has nothing to move from
    assert run(still).wh_tracking_consecutif_max == 0.0


def test_info_timing(make):
    yaw = [0.0 if i != 40 else 100.0 for i in range(80)]
    t = make(dict(n=80, steamid="a", team_num=3, yaw=yaw), dict(n=80, steamid="b", X=500.0, Z=2.0))
    m = [r for r in occlusion.occlusion_metrics(t, profile="replay").collect() if r.steamid == "a"][0]
    assert m.wh_info_timing_ratio == 1.0 and m.wh_preaim_score == pytest.approx(79 / 80, abs=1e-4)


# --- trigger -----------------------------------------------------------------------------------------------------

def triggered(make, shots, aligned_from, shot=1050, **enemy):
    yaw = [0.0 if 1000 + i >= aligned_from else 90.0 for i in range(80)]
    t = make(dict(n=80, steamid="a", team_num=3, yaw=yaw), dict(n=80, steamid="b", X=500.0) | enemy)
    return t, shots([shot] if isinstance(shot, int) else shot).select("match_id", F.col("user_steamid").alias("steamid"), "tick")


def test_reaction_time(make, shots):
    t, s = triggered(make, shots, 1048)
    m = {r.steamid: r.asDict() for r in trigger.trigger_metrics(t, s).collect()}
    assert m["a"]["triggerbot_rt_median"] == 31.25 and m["a"]["triggerbot_total_shots_analyzed"] == 1
    assert m["b"]["triggerbot_total_shots_analyzed"] == 0
    flags = [r.reason for r in trigger.trigger_flags(trigger.trigger_metrics(t, s)).collect()]
    assert flags == ["Anomalously fast median reaction time"]


def test_reaction_is_limited_to_a_second(make, shots):
    t, s = triggered(make, shots, 0, shot=1075)
    assert {r.steamid: r for r in trigger.trigger_metrics(t, s).collect()}["a"].triggerbot_rt_median == round(63 / 64 * 1000, 2)


def test_missing_target_row_ends_the_walk(make, shots):
    t, s = triggered(make, shots, 0)
    t = t.where("not (steamid = 'b' and tick = 1045)")
    assert {r.steamid: r for r in trigger.trigger_metrics(t, s).collect()}["a"].triggerbot_rt_median == 62.5


def test_bursts_count_once_per_run(make, shots):
    t, s = triggered(make, shots, 1010, shot=[1010, 1011, 1011, 1075])
    m = {r.steamid: r for r in trigger.trigger_metrics(t, s, cfg=replace(DEFAULT, burst_len=2)).collect()}["a"]
    assert m.triggerbot_burst_count == 1 and m.triggerbot_total_shots_analyzed == 3


def test_no_shots(make, shots):
    t, s = triggered(make, shots, 1048, shot=[])
    assert all(r.triggerbot_total_shots_analyzed == 0 for r in trigger.trigger_metrics(t, s).collect())


def test_burst_starts(make, spark):
    def starts(ticks):
        t = make(dict(n=len(ticks), tick=ticks)).withColumn("is_firing", F.lit(True))
        return sorted(r.tick for r in trigger.burst_starts(t).collect())

    assert starts([10, 11, 12, 20, 21, 40]) == [20, 40]  # the first run counts only alone
    assert starts([10, 11, 12]) == [10]


def test_first_source_wins(spark):
    s = lambda rows: spark.createDataFrame([("m", p, t) for p, t in rows], "match_id string, steamid string, tick long")
    got = {(r.steamid, r.tick) for r in trigger.shots_of(s([("a", 1), ("a", 1)]), s([("a", 9), ("b", 7)])).collect()}
    assert got == {("a", 1), ("b", 7)}


def crowd(spark, n, seed=1):
    """Players of two sides on one tick, at places with empty stretches, in a straight line and on top of each other; views in all directions, also past the zenith."""
    rng = np.random.default_rng(seed)
    x, y, z = rng.uniform(-1500, 1500, n), rng.choice([0.0, 300.0, 1000.0], n) + rng.uniform(0, 400, n), rng.uniform(0, 60, n)
    x[:20], y[:20] = 77.0, np.arange(20) * 50.0
    x[20:30], y[20:30], z[20:30] = 5.0, 5.0, 5.0
    yaw, pitch = rng.uniform(-180, 180, n), rng.uniform(-8, 8, n)
    yaw[:40], pitch[:40] = np.resize([0.0, 90.0, -90.0, 180.0], 40), 0.0
    pitch[40:80] = rng.uniform(172, 188, 40)
    rows = [("m", f"p{i:05d}", 7, float(x[i]), float(y[i]), float(z[i]), float(yaw[i]), float(pitch[i]), i % 2 + 2, 100) for i in range(n)]
    rows += [("m", "null view", 7, 0.0, 0.0, 0.0, None, None, 2, 100), ("m", "nowhere", 7, None, None, None, 0.0, 0.0, 3, 100)]
    t = spark.createDataFrame(rows, "match_id string, steamid string, tick long, X double, Y double, Z double, yaw double, pitch double, team_num int, health int")
    return t, t.select("match_id", "steamid", "tick")


@pytest.mark.parametrize("grid", [1, 3, 32, 200])
def test_crowded_tick_is_split_by_place(spark, monkeypatch, grid):
    """2,000 shooters on one tick: the same targets as with all pairs, whatever the cells; and the tick's pairs lie in many groups."""
    t, s = crowd(spark, 2000)
    want = {(r.steamid, r.target) for r in trigger.shot_targets(t, s, cfg=replace(DEFAULT, crowd=10**9), radius=20.0).collect()}
    assert len(want) > 300
    monkeypatch.setattr(trigger, "GRID", grid)
    assert {(r.steamid, r.target) for r in trigger.shot_targets(t, s, radius=20.0).collect()} == want


def test_all_players_at_one_place(spark):
    t, s = crowd(spark, 100)
    t = t.withColumns({"X": F.lit(1.0), "Y": F.lit(1.0)})
    want = {(r.steamid, r.target) for r in trigger.shot_targets(t, s, cfg=replace(DEFAULT, crowd=10**9), radius=50.0).collect()}
    assert want and {(r.steamid, r.target) for r in trigger.shot_targets(t, s, radius=50.0).collect()} == want


def test_reactions_over_blocks(spark, monkeypatch):
    """Walk back by hand: gaps in either player's rows, windows over the borders of blocks, several shots and targets."""
    rng = np.random.default_rng(2)
    rows, state = [], {}
    for who, team in (("a", 2), ("b", 3), ("c", 3)):
        for tick in range(900, 1200):
            if rng.random() < 0.03:
                continue
            x = 0.0 if who == "a" else 500.0
            y = 0.0 if who != "c" else 30.0
            yaw = 0.0 if rng.random() < 0.96 else 40.0
            state[who, tick] = (x, y, yaw)
            rows.append(("m", who, tick, x, y, 0.0, yaw, 0.0, team, 100))
    t = spark.createDataFrame(rows, "match_id string, steamid string, tick long, X double, Y double, Z double, yaw double, pitch double, team_num int, health int")
    shot_ticks = [k for w, k in state if w == "a" and k % 5 == 0]
    hits = trigger.shot_targets(t, spark.createDataFrame([("m", "a", k) for k in shot_ticks], "match_id string, steamid string, tick long"), radius=40.0)
    got = {(r.shot_tick, r.target): r.ticks_aligned for r in trigger.reaction_times(t, hits, radius=40.0).collect()}
    want = {}
    for h in hits.collect():
        since = 0
        for ago in range(64):
            me, he = state.get(("a", h.tick - ago)), state.get((h.target, h.tick - ago))
            if me is None:
                continue  # no row of the player: the walk goes on to his next one
            if he is None or me[2] != 0.0:
                break
            since = ago
        want[h.tick, h.target] = since
    assert got == want and len(set(got.values())) > 10
    plan = trigger.reaction_times(t, hits, radius=40.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


def test_both_jump_profiles_in_one_pass(spark, make):
    """The same rows as each profile by itself: players who are never alive, dead stretches, a first row in the air, one state only."""
    rng = np.random.default_rng(8)

    def player(who, **more):
        n = 160
        return dict(n=n, steamid=who, is_airborne=[bool(b) for b in rng.random(n) < 0.6], velocity_X=rng.uniform(-300, 300, n).tolist(),
                    velocity_Y=rng.uniform(-300, 300, n).tolist(), yaw=rng.uniform(-180, 180, n).tolist()) | more

    air = [True] + [bool(b) for b in rng.random(159) < 0.5]
    t = make(player("a"), player("never", health=0), player("first", is_airborne=air), player("dies", health=[100] * 60 + [0] * 40 + [100] * 60),
             player("sky", is_airborne=True), player("short", n=20, is_airborne=air[:20], velocity_X=0.0, velocity_Y=1.0, yaw=0.0))
    got = sorted(map(tuple, bhop.bhop_metrics_both(t).select("profile", *bhop.PLAYER, *bhop.METRICS).collect()))
    want = [(p, *r) for p in ("tabular", "replay") for r in bhop.bhop_metrics(t, profile=p).select(*bhop.PLAYER, *bhop.METRICS).collect()]
    assert got == sorted(map(tuple, want)) and len(got) == 11


def test_crowded_ticks_are_written_apart(make):
    """The table of crowded ticks is handed to ``keep``, so that its size is known; pairs are those of the lazy plan."""
    from dataclasses import replace

    from tickscope.config import DEFAULT
    from tickscope.operators import occlusion
    from tickscope.sources.workdir import materialize
    t = make(*[{"n": 4, "steamid": s, "team_num": 2 + i % 2, "X": 300.0 * i, "Y": 250.0 * i} for i, s in enumerate("abcdef")])
    kept = []

    def keep(df, name):
        kept.append((name, materialize(df, name)))
        return kept[-1][1]

    for crowd, ticks in ((64, 0), (4, 4)):
        cfg = replace(DEFAULT, crowd=crowd)
        got = occlusion.sight_pairs(t, cfg, keep=keep).collect()
        assert sorted(got) == sorted(occlusion.sight_pairs(t, cfg).collect()) and got
        assert kept[-1][0] == "crowded" and kept[-1][1].count() == ticks
