"""Relational work over results: rosters, rankings, timelines, match verdicts, stores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.operators.blocks import PLAYER, block_index
from tickscope.sources.workdir import Keep, lazy

NOT_A_PLAYER = ("", "0", "Player_Unknown")


def roster(ticks: DataFrame) -> DataFrame:
    """Distinct players per match."""
    return ticks.where(F.col("steamid").isNotNull() & ~F.col("steamid").isin(*NOT_A_PLAYER)).select(*PLAYER).distinct()


def _by_team(ticks: DataFrame, *more: Column) -> DataFrame:
    return ticks.where(F.col("steamid").isNotNull() & ~F.col("steamid").isin(*NOT_A_PLAYER)).groupBy(
        *PLAYER, "team_num").agg(F.count(F.lit(1)).alias("n"), *more)


def _best_team() -> Column:
    seen = F.col("team_num").isNotNull()
    best = F.max_by(F.when(seen, F.col("team_num")), F.when(seen, F.struct(F.col("n"), -F.col("team_num"))))
    return F.coalesce(best, F.lit(0)).cast("int").alias("team_number")


def main_team(ticks: DataFrame) -> DataFrame:
    """Most frequent side of a player, smallest on ties, 0 if unknown. Counts are aggregated before they are compared."""
    return _by_team(ticks).groupBy(*PLAYER).agg(_best_team())


def players(ticks: DataFrame) -> DataFrame:
    """Roster with name and side in one pass."""
    return _by_team(ticks, F.min("name").alias("name")).groupBy(*PLAYER).agg(F.min("name").alias("name"), _best_team())


def match_span(ticks: DataFrame, header: DataFrame | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Ticks covered and duration: the header's playback time if positive, else ticks / tickrate."""
    d = ticks.groupBy("match_id").agg((F.max("tick") - F.min("tick") + 1).alias("total_ticks"))
    if header is None:
        d = d.withColumn("playback_time", F.lit(None).cast("double"))
    else:
        d = d.join(header.select("match_id", "playback_time"), "match_id", "left")
    dur = F.coalesce(F.when(F.col("playback_time") > 0, F.col("playback_time")), F.col("total_ticks") / cfg.tickrate)
    return d.select("match_id", "total_ticks", dur.alias("duration_seconds"))


def verdict_counts(results: DataFrame) -> DataFrame:
    def n(cond, name):
        return F.count_if(cond).alias(name)

    v, t = F.col("verdict"), F.col("team_number")
    return results.groupBy("match_id").agg(
        n(v == "CHEATER", "cheaters"), n(v == "SUSPECT", "suspects"), n(v == "CLEAN", "clean"), n(v == "ERROR", "errors"),
        n(t == 3, "ct"), n(t == 2, "t"), F.count(F.lit(1)).alias("players"))


def first_names(results: DataFrame, verdict: str, n: int = 3, out: str = "names") -> DataFrame:
    """Names of the first n players (roster order) with a verdict; the limit is applied before the shuffle."""
    w = Window.partitionBy("match_id").orderBy("steamid")
    top = results.where(F.col("verdict") == verdict).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"])
    return top.groupBy("match_id").agg(F.array_join(names, ", ").alias(out))


def match_verdict(results: DataFrame) -> DataFrame:
    c = verdict_counts(results)
    d = c.join(first_names(results, "CHEATER", out="_c"), "match_id", "left").join(
        first_names(results, "SUSPECT", out="_s"), "match_id", "left")
    nc, ns, ne = (F.col(x).cast("string") for x in ("cheaters", "suspects", "errors"))
    base = (F.when(F.col("cheaters") > 0, F.concat(
                nc, F.lit(" SUSPICION(S) ÉLEVÉE(S) ("), F.col("_c"), F.lit(")"),
                F.when(F.col("suspects") > 0, F.concat(F.lit(" | "), ns, F.lit(" SUSPECT(S)"))).otherwise("")))
            .when(F.col("suspects") > 0, F.concat(ns, F.lit(" JOUEUR(S) SUSPECT(S) ("), F.col("_s"), F.lit(")")))
            .otherwise("AUCUN SIGNAL FORT DÉTECTÉ"))
    flagged = (F.col("cheaters") > 0) | (F.col("suspects") > 0)
    text = (F.when(F.col("errors") == 0, base)
            .when(flagged, F.concat(base, F.lit(" [MATCH INCOMPLET: "), ne, F.lit(" ERREUR(S)]")))
            .otherwise(F.concat(F.lit("MATCH INCOMPLET ("), ne, F.lit(" ERREUR(S) D'ANALYSE)"))))
    return d.select(*c.columns, text.alias("global_verdict"))


def verdict_rank(other: int = 3, column: str = "verdict") -> Column:
    v = F.col(column)
    return F.when(v == "CHEATER", 0).when(v == "SUSPECT", 1).when(v == "CLEAN", 2).otherwise(other)


def rank_players(results: DataFrame, other: int = 3) -> DataFrame:
    """Sorted by verdict, then score; a global sort is range-partitioned. Ids break ties."""
    return results.withColumn("verdict_rank", verdict_rank(other)).orderBy(
        "verdict_rank", F.desc("suspicion_score"), *PLAYER)


def with_position(ranked: DataFrame, other: int = 3, name: str = "position") -> DataFrame:
    """Place of every player in the order of ``rank_players``. Equal ranks and scores form blocks, counted before they are ordered."""
    order = F.struct(verdict_rank(other), -F.round(F.col("suspicion_score") * 100).cast("long"))
    d = block_index(ranked.withColumns({"_all": F.lit(1)}), {"_p": F.lit(1)}, ["_all"], PLAYER, block=order)
    return d.withColumn(name, F.col("_p_i")).drop("_all", "_p_i", "_p_n", "_blk")


def newest(df: DataFrame, n: int = 50, by: str = "modified_time", tie: str = "path") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def retention_victims(store: DataFrame, keep: int = DEFAULT.keep_results, by: str = "last_used",
                      key: str = "result_key") -> DataFrame:
    """Rows beyond the newest ``keep``; the kept set is bounded by ``keep``."""
    kept = store.orderBy(F.desc(by), key).limit(keep).select(key)
    return store.join(F.broadcast(kept), key, "left_anti")


def worst_snap(events: DataFrame, min_angle: float = 5.0) -> DataFrame:
    """Largest snap per player; the earliest wins a tie."""
    best = F.max_by(F.struct("tick", "snap_angle"), F.struct(F.col("snap_angle"), -F.col("tick")))
    return events.where("type = 'aim_snap'").groupBy(*PLAYER).agg(best.alias("b")).select(
        *PLAYER, F.col("b.tick").alias("tick"), F.col("b.snap_angle").alias("snap_angle")).where(
        F.col("snap_angle") >= min_angle)


EVENT_SCHEMA = {
    "type": "string", "tick": "long", "start_tick": "long", "end_tick": "long", "snap_angle": "double",
    "delta_yaw": "double", "delta_pitch": "double", "jerk": "double", "weapon": "string", "chain_length": "long",
    "avg_speed": "double", "duration_ticks": "long", "target_name": "string", "target_steamid": "string",
    "distance": "double", "reason": "string", "value": "double",
}


def event_rows(df: DataFrame) -> DataFrame:
    """Project one event kind on the common event columns."""
    return df.select(*PLAYER, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                                for c, t in EVENT_SCHEMA.items()])


# order of the kinds among events of the same tick
KIND_ORDER = ("aim_snap", "bhop_chain", "wh_lock", "spinbot_detected", "triggerbot_event")


def event_timeline(*kinds: DataFrame, keep: Keep = lazy) -> DataFrame:
    """Union of the event kinds with ``seq``, the position in the player's timeline (tick, else start tick, else 0).

    Positions read the union twice; written with ``keep``, the kinds are worked out once.
    """
    parts = [event_rows(k) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kind = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("type"))
    out = out.withColumns({"at_tick": F.coalesce("tick", "start_tick", F.lit(0)), "_kind": kind})
    order = ("at_tick", "_kind", "end_tick", "reason")
    return block_index(keep(out, "timeline"), {"seq": F.lit(1)}, PLAYER, order).drop("seq_n", "_kind").withColumnRenamed("seq_i", "seq")


def earliest_view_tick(timeline: DataFrame, lead_in: int = 350) -> DataFrame:
    """Where to start watching: the first event less a lead-in, not below zero."""
    return timeline.groupBy(*PLAYER).agg(F.greatest(F.min("at_tick") - lead_in, F.lit(0)).alias("view_tick"))


def first_events(timeline: DataFrame, n: int) -> DataFrame:
    return timeline.where(F.col("seq") <= n)


def resolve_players(refs: DataFrame, roster_: DataFrame, column: str = "identifier") -> DataFrame:
    """Identifier (id or name) to player: one equi-join with a map of both instead of an OR condition.

    Ids come before names; of players who share a name the smallest id stands for it.
    """
    keys = F.array(F.struct(F.col("steamid").alias("k"), F.lit(0).alias("by")), F.struct(F.col("name").alias("k"), F.lit(1).alias("by")))
    known = roster_.select("match_id", "steamid", "name", F.inline(keys)).where("k is not null")
    best = F.min(F.struct("by", "steamid", "name"))
    known = known.groupBy("match_id", F.col("k").alias(column)).agg(best.alias("_p"))
    return refs.join(known, ["match_id", column], "left").select(
        *refs.columns, F.coalesce("_p.name", F.col(column)).alias("resolved_name"), F.col("_p.steamid").alias("resolved_steamid"))


def fingerprint(*parts: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def match_fingerprint(df: DataFrame, model_fp: str = "default", cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Key of a stored result: where the input is, its size and time, and every version that shapes the output."""
    if dict(df.dtypes)["modified_time"] == "timestamp_ntz":
        micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', modified_time)")
    else:
        micros = F.unix_micros("modified_time")
    head = [F.sha2("head", 256)] if "head" in df.columns else []  # first bytes of the file, if they were read
    return df.withColumn("fingerprint", fingerprint(
        F.lit(cfg.engine_version), F.lit(cfg.feature_schema_version), F.lit(model_fp), F.col("path"), F.col("length"),
        micros, *head))


def not_yet_analysed(candidates: DataFrame, store: DataFrame) -> DataFrame:
    return candidates.join(store.select("fingerprint"), "fingerprint", "left_anti")


def leaked_keys(rows: DataFrame, key: Sequence[str] = PLAYER, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(*key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def leakage_by_pair(rows: DataFrame, key: Sequence[str] = PLAYER, split: str = "split") -> DataFrame:
    """Shared keys per pair of splits, in one aggregation; a group is at most the three flags."""
    in_ = {s: F.max(F.when(F.col(split) == s, 1).otherwise(0)).alias(s) for s in ("train", "validation", "test")}
    k = rows.groupBy(*key).agg(*in_.values())
    return k.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}")
                   for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))])


def assert_no_leakage(rows: DataFrame, key: Sequence[str] = PLAYER) -> None:
    bad = [r for r in leaked_keys(rows, key).limit(5).collect()]
    if bad:
        raise RuntimeError(f"keys shared between splits, for example {bad}")
