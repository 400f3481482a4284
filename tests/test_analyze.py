"""End to end: raw files to verdicts."""

import json
import os

from pyspark.sql import functions as F

from tickscope.plans import analyze
from tickscope.sources import ticks as readers


def scene(make):
    """A spinning player, a scripted jumper, a quiet one and an idle one, two per side."""
    n = 120
    air = ([False] * 4 + [True] * 8) * 10
    script = [True] * 9 + ([False] + [True] * 8) * 12 + [True] * 3
    quiet = [0.1 * i for i in range(n)]
    return make(
        dict(n=n, steamid="76561198000000001", name="spin", team_num=3, yaw=[(120 * i) % 360 - 180.0 for i in range(n)], X=5000.0),
        dict(n=n, steamid="76561198000000002", name="jump", team_num=2, yaw=quiet, is_airborne=script, velocity_X=250.0, Y=5000.0),
        dict(n=n, steamid="76561198000000003", name="quiet", team_num=2, yaw=quiet, is_airborne=air, X=-5000.0),
        dict(n=n, steamid="76561198000000004", name="idle", team_num=3, Y=-5000.0))


def test_verdicts(spark, make, shots):
    t, f = scene(make), shots([1050], "76561198000000003")
    players, matches = analyze.analyse_matches(t, f)
    got = {r.name: r for r in players.collect()}
    assert got["spin"].verdict == "CHEATER" and got["spin"].suspicion_score == 90.0 and "SPINBOT" in " ".join(got["spin"].pills)
    assert got["jump"].verdict in ("SUSPECT", "CHEATER") and any("BHOP" in p for p in got["jump"].pills)
    assert got["quiet"].verdict == "CLEAN" and got["idle"].verdict == "CLEAN" and got["idle"].suspicion_score == 0.0
    m = matches.collect()[0]
    assert (m.total_ticks, m.duration_seconds, m.players) == (120, 1.875, 4) and "spin" in m.global_verdict


def test_stored_and_lazy_plans_agree(spark, make, shots):
    t, f = scene(make), shots([1050], "76561198000000003")
    for profile in ("tabular", "replay"):
        a = analyze.player_metrics(t, f, profile=profile).orderBy("steamid").collect()
        assert a == analyze.player_metrics(t, f, profile=profile, stored=False).orderBy("steamid").collect() and len(a) == 4


def test_timeline(spark, make, shots):
    t, f = scene(make), shots([1050], "76561198000000003")
    ev = analyze.combat_events(t, f, analyze.player_metrics(t, f)).orderBy("steamid", "seq").collect()
    kinds = {(r.steamid[-1], r.type) for r in ev}
    assert {("1", "aim_snap"), ("1", "spinbot_detected"), ("2", "bhop_chain")} <= kinds
    seq = [r.seq for r in ev if r.steamid.endswith("1")]
    assert seq == list(range(1, len(seq) + 1))


def test_from_files(spark, make, tmp_path):
    t = scene(make).drop("match_id", "name")
    copy = t.where("tick = 1003").withColumn("yaw", F.lit(99.0))  # a second row of the same tick loses
    t.coalesce(1).orderBy("tick").unionByName(copy).coalesce(1).write.parquet(str(tmp_path / "cls" / "g.parquet"))
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "g.json").write_text(json.dumps({"weapon_fire": [{"tick": 1050, "user_steamid": "76561198000000003"}]}))
    raw = readers.read_ticks(spark, str(tmp_path / "cls" / "g.parquet"), match_column=False).withColumn("match_id", F.lit("ev_g"))
    ticks = analyze.prepare(raw)
    assert ticks.count() == 480 and ticks.where("yaw = 99.0").count() == 0
    fires = readers.explode_events(readers.read_event_documents(spark, str(tmp_path / "ev")), "weapon_fire").withColumnRenamed("actor", "user_steamid")
    players, _ = analyze.analyse_matches(ticks, fires.select("match_id", "tick", "user_steamid"))
    assert {r.steamid[-1]: r.verdict for r in players.collect()}["1"] == "CHEATER"


def test_matches_arrive(spark, make, tmp_path):
    from datetime import datetime, timedelta

    from tickscope.streaming import arrivals
    src, polls, out, cp = (str(tmp_path / d) for d in ("in", "polls", "out", "cp"))
    clock = iter(datetime(2024, 1, 1) + timedelta(seconds=s) for s in range(100))
    whole = scene(make).withColumn("match_id", F.lit("two")).drop("name")

    def analyse_now():
        none = lambda t: t.select("match_id", "tick", F.col("steamid").alias("user_steamid")).where("false")
        arrivals.analyse_on_arrival(spark, polls, none, out, cp).awaitTermination()

    def arrive(df, looks=3):
        df.coalesce(1).write.mode("append").parquet(src)
        for _ in range(looks):
            arrivals.record_poll(spark, src, polls, "*.parquet", next(clock))
        analyse_now()
        return arrivals.latest_results(spark, f"{out}/players")

    others = scene(make).drop("match_id").crossJoin(spark.range(5).select(F.concat(F.lit("other"), "id").alias("match_id"))).drop("name")
    others.repartition(5, "match_id").write.parquet(src)
    first = arrive(scene(make).withColumn("match_id", F.lit("one")).drop("name"))
    assert first.count() == 24
    arrive(whole.where("tick < 1060"))  # half of a match, the rest comes in a later batch
    arrive(whole.where("tick >= 1060"), looks=1)  # not yet written to the end, as far as one poll can tell
    for _ in range(2):
        arrivals.record_poll(spark, src, polls, "*.parquet", next(clock))
    analyse_now()
    both = arrivals.latest_results(spark, f"{out}/players").where("match_id in ('one', 'two')").orderBy("match_id", "steamid").collect()
    assert [r.match_id for r in both] == ["one"] * 4 + ["two"] * 4
    assert [(r.steamid, r.verdict, r.suspicion_score, r.spinbot_yaw_speed_max) for r in both[:4]] == [(r.steamid, r.verdict, r.suspicion_score, r.spinbot_yaw_speed_max) for r in both[4:]]
    assert arrivals.latest_results(spark, f"{out}/events").count() > 0
    # a batch opens its new files and those of its matches, however many matches the folder holds
    log = [(r.matches, r.new_files, r.files_read) for r in spark.read.parquet(f"{out}/log").orderBy("batch").collect()]
    assert log[1:] == [(1, 1, 1), (1, 1, 2)] and log[0][0] == 6 and log[0][1] == log[0][2] <= 6


def test_shots_without_fire_events(spark, make, shots):
    t = scene(make).withColumn("is_firing", (F.col("steamid") == "76561198000000003") & F.col("tick").between(1050, 1052))
    got = analyze.shots_from(t, shots([])).collect()
    assert [(r.steamid, r.tick) for r in got] == [("76561198000000003", 1050)]
    assert [r.tick for r in analyze.shots_from(t, shots([1010], "76561198000000003")).collect()] == [1010]


def test_work_is_removed(spark, make, shots, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/tickscope"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    analyze.analyse_to(str(tmp_path / "out"), scene(make), shots([1050], "76561198000000003"))
    assert spark.read.parquet(str(tmp_path / "out" / "players")).count() == 4 and set(os.listdir(root)) == before


def test_snaps_of_stored_rows(spark, make, shots):
    """Stored rows get the rows around a snap by a window over blocks of positions: no join, and nothing at all where only the events are read."""
    from dataclasses import replace

    from tickscope.config import DEFAULT
    from tickscope.operators import aim, results
    cfg = replace(DEFAULT, row_block=32)
    rows = aim.aim_rows(scene(make), shots([1050], "76561198000000003"), cfg=cfg)
    kept = analyze.materialize(rows.drop("around"), "kept")
    want = sorted(map(str, aim.snap_events_of(rows, cfg).collect()))
    assert len(want) > 100 and sorted(map(str, aim.snap_events_of(kept, cfg).collect())) == want

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "Join" not in plan(aim.snap_events_of(kept, cfg)) and "Window" not in plan(results.event_rows(aim.snap_events_of(kept, cfg)))


def test_some_detectors(spark, make, shots):
    t, f = scene(make), shots([1050], "76561198000000003")
    some = analyze.player_metrics(t, f, detectors=("spin", "trigger"))
    assert not [c for c in some.columns if c.startswith(("aim_", "bhop_", "wh_"))]
    whole = analyze.player_metrics(t, f).select(*some.columns)
    assert some.orderBy("steamid").collect() == whole.orderBy("steamid").collect()


def test_some_players(spark, make, shots):
    """Metrics of some players are those they have among all: the others are still seen."""
    t, f = scene(make).withColumns({"X": F.col("X") / 10, "Y": F.col("Y") / 10}), shots([1050], "76561198000000003").unionByName(shots([1060], "76561198000000002"))
    of = t.where("name in ('quiet', 'idle')").select("match_id", "steamid").distinct()
    for profile in ("tabular", "replay"):
        some = analyze.player_metrics(t, f, of=of, profile=profile, radius=200.0)
        whole = analyze.player_metrics(t, f, profile=profile, radius=200.0).join(of, ["match_id", "steamid"], "left_semi").select(*some.columns)
        got = some.orderBy("steamid").collect()
        assert len(got) == 2 and any(r.wh_ratio_lock_cache for r in got) and got == whole.orderBy("steamid").collect()


def test_nothing_is_worked_out_twice(spark, make, shots):
    """Shots, jump intervals, verdicts and the union of the events are written once per analysis, which gives the same as separate steps."""
    t, f, written = scene(make), shots([1050], "76561198000000003"), []

    def keep(df, name):
        written.append(name)
        return analyze.materialize(df, name)

    whole = analyze.analyse(t, f, keep=keep)
    assert all(written.count(name) == 1 for name in ("shots", "kinematics", "intervals", "judged", "timeline")), written
    m = analyze.player_metrics(t, f)
    events = analyze.combat_events(t, f, m).orderBy("steamid", "seq").collect()
    assert len({r.type for r in events}) >= 3 and whole.events.orderBy("steamid", "seq").collect() == events
    players, matches = analyze.analyse_matches(t, f)
    assert whole.players.orderBy("steamid").collect() == players.select(*whole.players.columns).orderBy("steamid").collect()
    assert whole.matches.collect() == matches.collect()
