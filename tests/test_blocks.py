"""Blocked computation equals plain windows, also with one hot key and blocks far smaller than the data."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickscope.config import DEFAULT
from tickscope.operators import aim, bhop, spin
from tickscope.operators.blocks import PLAYER, block_index, block_window, consecutive_runs, exact_percentile, row_blocks
from tickscope.operators.timeline import kinematics, timeline

SMALL = replace(DEFAULT, tick_block=16, row_block=32)


@pytest.fixture(scope="module")
def skewed(spark):
    """Eight players; the first holds more than a third of all rows, with gaps and deaths."""
    rng = np.random.default_rng(7)
    parts = []
    for p in range(8):
        n = 1500 if p == 0 else 300
        tick = np.cumsum(rng.choice([1, 1, 1, 1, 2, 40], n))
        parts.append(pd.DataFrame({
            "match_id": "m", "steamid": f"p{p}", "name": f"p{p}", "tick": tick, "X": 0.0, "Y": 0.0, "Z": 0.0,
            "pitch": rng.uniform(-95, 95, n).round(3), "yaw": rng.choice([rng.uniform(-180, 180), 0.0, 170.0, -170.0], n) + rng.uniform(-2, 2, n).round(3),
            "team_num": 2, "health": np.where((p == 7) | (rng.random(n) < 0.1), 0, 100), "spotted": False,
            "is_airborne": rng.random(n) < 0.6, "velocity_X": rng.normal(size=n), "velocity_Y": rng.normal(size=n), "active_weapon_name": "ak"}))
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def close(a, b, keys):
    a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6)


def test_block_index(spark, skewed):
    d = frame(spark, skewed)
    got = block_index(d, {"all": F.lit(1), "alive": F.col("health") > 0}, PLAYER, ("tick",), 16).select(
        *PLAYER, "tick", "all_i", "all_n", "alive_i", "alive_n").toPandas()
    s = skewed.sort_values(["steamid", "tick"])
    g = s.groupby("steamid")
    want = s[[*PLAYER, "tick"]].assign(all_i=g.cumcount() + 1, all_n=g["tick"].transform("size"),
                                       alive_i=(s.health > 0).groupby(s.steamid).cumsum(),
                                       alive_n=(s.health > 0).groupby(s.steamid).transform("sum"))
    close(got, want, [*PLAYER, "tick"])


@pytest.mark.parametrize("before,after", [(0, 5), (3, 0), (4, 4)])
def test_row_blocks_halo(spark, skewed, before, after):
    d = block_index(frame(spark, skewed), {"row": F.lit(1)}, PLAYER, ("tick",), 16)
    w = block_window("row_i").rowsBetween(-before, after)
    got = row_blocks(d, before, after, "row_i", 8).withColumn("v", F.sum("pitch").over(w)).where("_own").select(
        *PLAYER, "tick", "v").toPandas()
    s = skewed.sort_values(["steamid", "tick"])
    parts = []
    for _, g in s.groupby("steamid"):
        p = g["pitch"].to_numpy()
        parts.append(g[[*PLAYER, "tick"]].assign(v=[p[max(0, i - before):i + after + 1].sum() for i in range(len(p))]))
    close(got, pd.concat(parts), [*PLAYER, "tick"])


def test_runs_longer_than_a_block(spark):
    seq = [*range(1, 101), *range(200, 203), 300]
    d = spark.createDataFrame([("m", "a", i) for i in seq] + [("m", "b", 5)], "match_id string, steamid string, i long")
    got = {(r.steamid, r.run_start, r.run_end, r.run_len) for r in consecutive_runs(d, "i", PLAYER, width=8).collect()}
    assert got == {("a", 1, 100, 100), ("a", 200, 202, 3), ("a", 300, 300, 1), ("b", 5, 5, 1)}


@pytest.mark.parametrize("p", [0.0, 0.04, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, p):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 5 + ["b", "c"], 3000)})
    pdf["x"] = np.where(rng.random(3000) < 0.3, 0.0, rng.normal(0, 30, 3000).round(4))
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["one", "two", "two", "far", "far"], "x": [3.5, -1.0, 1e7, 5e5, 6e5]})])
    want = pdf.groupby("k")["x"].quantile(p)
    for widths in ((1 / 64,), (4.0, 1 / 256)):
        got = exact_percentile(spark.createDataFrame(pdf), "x", p, "q", ("k",), widths).toPandas().set_index("k")["q"]
        assert np.allclose(got.sort_index(), want.sort_index())


def test_detectors_do_not_depend_on_block_size(spark, skewed, shots):
    d = frame(spark, skewed)
    f = shots(sorted(skewed[skewed.steamid == "p0"].tick.iloc[::40].tolist()), "p0")
    for fn in (lambda c: aim.aim_metrics(d, f, cfg=c), lambda c: bhop.bhop_metrics(d, cfg=c),
               lambda c: bhop.bhop_metrics(d, cfg=c, profile="replay"), lambda c: spin.spin_metrics(d, cfg=c),
               lambda c: bhop.chain_events(d, cfg=replace(c, chain_event=2)),
               lambda c: aim.snap_events(d, cfg=c).withColumn("trajectory", F.col("trajectory").cast("string"))):
        a, b = fn(SMALL).toPandas(), fn(DEFAULT).toPandas()
        keys = [c for c in ("steamid", "tick", "start_tick") if c in a.columns]
        close(a, b, keys)


def test_kinematics_against_pandas(spark, skewed):
    got = kinematics(timeline(frame(spark, skewed), cfg=SMALL), SMALL).select(
        *PLAYER, "tick", "speed", "acceleration", "jerk", "direction_change", "spin_mean", "pitch_var").toPandas()
    parts = []
    for _, g in skewed.sort_values(["steamid", "tick"]).groupby("steamid"):
        g = g[g.health > 0] if (g.health > 0).any() else g
        ok = g.tick.diff() == 1
        dy = np.where(ok, (g.yaw.diff() + 180) % 360 - 180, 0.0)
        dp = np.where(ok, g.pitch.diff(), 0.0)
        speed = pd.Series(np.hypot(dy, dp), index=g.index)
        acc = pd.Series(np.abs(np.where(ok, speed.diff(), 0.0)), index=g.index)
        jerk = np.abs(np.where(ok, acc.diff(), 0.0))
        sign = pd.Series(np.sign(dy), index=g.index)
        parts.append(g[[*PLAYER, "tick"]].assign(
            speed=speed, acceleration=acc, jerk=jerk, direction_change=(sign != sign.shift()) & (np.abs(dy) > 0.05) & ok,
            spin_mean=pd.Series(np.abs(dy), index=g.index).rolling(16).mean(), pitch_var=g.pitch.rolling(8).var()))
    close(got, pd.concat(parts), [*PLAYER, "tick"])
