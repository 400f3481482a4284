"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os
from datetime import datetime

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from tickscope.plans import inputs
from tickscope.plans.registry import learning

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SAMPLE = ["AIM-8", "AIM-13", "BHP-5", "BHP-10", "SPN-7", "OCC-10", "OCC-11", "TRG-4", "RUL-14", "VRD-3", "AGG-5", "SET-1", "RPT-2", "SRC-2",
          "SNK-3", "DST-4", "ML-5", "STR-3", "JOIN-9", "CLN-3"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    got, want = driver.queries()[name](spark, SF).toPandas(), con.execute(driver.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    d = driver.entry(spark)
    assert d.count() > 0 and {r.verdict for r in d.select("verdict").distinct().collect()} <= {"CLEAN", "SUSPECT", "CHEATER"}


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_cubes_beyond_64_bits(spark, tmp_path):
    """PRJ-4 on ids whose third power is no 64-bit number."""
    ids = [3, 2_097_151, 2_097_152, 5_999_999, 36_000_001, 3_999_999_999]
    rows = [(i, datetime(2024, 1, 2, 3, 4, 5)) for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.mb for r in driver.queries()["PRJ-4"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(i ** 3 % 4000000007 // (4000000, 4000, 40, 1)[i % 4] / 1048576, abs=0.0051) for i in ids}


@pytest.mark.parametrize("name", ["DST-5", "AGG-7", "DST-6"])
def test_labels_run_no_detector(spark, con, name, monkeypatch):
    """Labels, and what is counted by them, follow from the roster and the manifest: the same as the SQL without any metrics."""
    def none(*_):
        raise AssertionError("metrics are computed for a label")

    monkeypatch.setattr(inputs, "_STORED", {})
    monkeypatch.setattr(inputs, "metrics", none)
    monkeypatch.setattr(inputs, "kinematics", none)
    test_same_as_sql(spark, con, name)


def test_training_measures_its_players_only(spark, con, monkeypatch):
    """The forest of ML-2 needs the three detectors its features come from, for the players it is fitted on; their rows are those of the whole feature table."""
    def none(*_):
        raise AssertionError("metrics are computed for a model")

    monkeypatch.setattr(inputs, "_STORED", {})
    with monkeypatch.context() as m:
        m.setattr(inputs, "metrics", none)
        m.setattr(inputs, "kinematics", none)
        few = learning.train_rows(spark, SF).orderBy("player_key").toPandas()
    want = con.execute(driver.oracle_sql()["ML-2"]).df()
    assert few.label.value_counts().to_dict() == dict(zip(want.label, want.trained_on))
    whole = learning.features(spark, SF)
    assert 0 < len(few) < whole.count()
    pd.testing.assert_frame_equal(few, learning.train_rows(spark, SF).orderBy("player_key").toPandas())
