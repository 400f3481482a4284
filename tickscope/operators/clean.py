"""Cleaning and row selection on tick and event frames."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = ("tick", "steamid", "X", "Y", "Z", "pitch", "yaw")
CRITICAL_NUMERIC = ("X", "Y", "Z", "pitch", "yaw", "tick")
NO_ID = ("", "0", "nan", "None")


def coerce_numeric(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text that is no number becomes null instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.col(c))


def drop_non_finite(df: DataFrame, columns: Sequence[str] = CRITICAL_NUMERIC) -> DataFrame:
    """NaN and infinities become null; rows with a null in ``columns`` go."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: finite(c) for c in cols}).dropna(subset=cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark sorts NaN above every number; every double column gets null instead."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def deduplicate_ticks(df: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """First row per (match, tick, player) in the order of ``tie_break``.

    Spark limits each key to its first row before the shuffle (window group limit), so a key with very many copies
    sends one row per task.
    """
    w = Window.partitionBy("match_id", "steamid", "tick").orderBy(*tie_break)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def normalize_id(c: str | Column) -> Column:
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(s, r"\.0$", "")


def valid_id(c: str | Column, min_len: int = 5) -> Column:
    """Usable id: not one of the empty markers and not too short."""
    s = F.col(c) if isinstance(c, str) else c
    return s.isNotNull() & ~s.isin(*NO_ID) & (F.length(s) >= min_len)


def clean_ids(df: DataFrame, column: str = "steamid", min_len: int = 5) -> DataFrame:
    return df.withColumn(column, normalize_id(column)).where(valid_id(column, min_len))


def alive(df: DataFrame) -> DataFrame:
    return df.where("health > 0")


def not_dead(df: DataFrame) -> DataFrame:
    """Rows of the living; a source without health says nothing, so its rows stay."""
    return df.where("health is null or health > 0") if "health" in df.columns else df


def player_rows(df: DataFrame, identifier: str) -> DataFrame:
    """Rows of one player given by id or by name."""
    who = F.trim(F.lit(identifier))
    return df.where((F.col("steamid") == who) | (F.col("name") == who))


def events_by_player(events: DataFrame) -> DataFrame:
    """One row per (event, person in it): actor and victim, by id or name, without repeats.

    Needs ``event_uid``; a person listed twice in an event counts once.
    """
    people = [c for c in ("user_steamid", "attacker_steamid", "user_name", "attacker_name", "steamid")
              if c in events.columns]
    names = F.array_distinct(F.filter(F.array(*[F.col(c).cast("string") for c in people]), lambda x: x.isNotNull()))
    return events.withColumn("person", F.explode(names))


def normalize_events(df: DataFrame, kind: str) -> DataFrame:
    """Common event shape: actor / victim as text, integer tick, weapon may be null."""
    has = set(df.columns)

    def text(c):
        return F.col(c).cast("string") if c in has else F.lit(None).cast("string")

    is_fire = kind == "weapon_fire"
    actor = text("user_steamid") if is_fire else text("attacker_steamid")
    victim = F.lit(None).cast("string") if is_fire else text("user_steamid")
    name = F.coalesce(text("user_steamid"), text("user_name"))
    return df.select(
        "match_id", F.lit(kind).alias("event_name"), F.col("tick").try_cast("long").alias("tick"),
        actor.alias("actor"), victim.alias("victim"), name.alias("user_name"), text("weapon").alias("weapon"),
    ).where("tick is not null")


def team_filter(df: DataFrame, team: str) -> DataFrame:
    wanted = {"CT": 3, "T": 2}.get(team)
    return df if wanted is None else df.where(F.col("team_number") == wanted)
