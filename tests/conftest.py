import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SCHEMA = """match_id string, steamid string, name string, tick long, X double, Y double, Z double, pitch double, yaw double,
  team_num int, health int, spotted boolean, is_airborne boolean, velocity_X double, velocity_Y double,
  active_weapon_name string"""
COLUMNS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
FIRES = "match_id string, tick long, user_steamid string, user_name string, weapon string"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Ticks of one player from column lists; anything not given has a neutral value."""
    base = dict(X=0.0, Y=0.0, Z=0.0, pitch=0.0, yaw=0.0, team_num=2, health=100, spotted=False, is_airborne=False,
                velocity_X=0.0, velocity_Y=0.0, active_weapon_name="ak")

    def build(*players, match="m"):
        rows = []
        for p in players:
            n = p["n"]
            start = p.get("start", 1000)
            who = p.get("steamid", "a")
            for i in range(n):
                v = {k: (p[k][i] if isinstance(p.get(k), list) else p.get(k, d)) for k, d in base.items()}
                tick = p["tick"][i] if "tick" in p else start + i
                row = {"match_id": p.get("match", match), "steamid": who, "name": p.get("name", who), "tick": tick, **v}
                rows.append(tuple(row[c] for c in COLUMNS))
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def shots(spark):
    def build(ticks, who="a", match="m"):
        return spark.createDataFrame([(match, t, who, who, "ak") for t in ticks], FIRES)

    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
