"""Rule flags, suspicion score, verdict and display bands: projections over the metric columns.

Texts are fixed values of the output contract.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT, AnalysisConfig
from tickscope.functions.frames import one_row
from tickscope.functions.text import fixed
from tickscope.functions.numbers import stable_round

RULE_TYPE = "struct<rule:string,factor:string,cheat:string,pills:array<string>,rage:boolean>"


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column
    factor: Column
    cheat: Column
    pills: tuple[Column, ...]
    rage: bool = False

    def column(self) -> Column:
        body = F.struct(F.lit(self.name).alias("rule"), self.factor.alias("factor"), self.cheat.alias("cheat"),
                        F.array(*self.pills).alias("pills"), F.lit(self.rage).alias("rage"))
        return F.when(F.coalesce(self.when, F.lit(False)), body)


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n(c: str) -> Column:
    return F.col(c).cast("long").cast("string")


def rules(cfg: AnalysisConfig = DEFAULT) -> list[Rule]:
    """All rules in reporting order."""
    c = F.col
    snap, jerk = fixed("aim_p99"), fixed("aim_jerk_max")
    ratio1, ratio0 = fixed(c("bhop_ratio_parfaits") * 100.0), fixed(c("bhop_ratio_parfaits") * 100.0, 0)
    strict = fixed(c("wh_ratio_lock_strict") * 100.0)
    chain, run, flips = _n("bhop_chaine_max"), _n("wh_tracking_consecutif_max"), _n("spinbot_desync_max_ticks")
    spin, bursts = fixed("spinbot_yaw_speed_max"), _n("triggerbot_burst_count")
    med1, med0 = fixed("triggerbot_rt_median"), fixed("triggerbot_rt_median", 0)
    std1, std0 = fixed("triggerbot_rt_std"), fixed("triggerbot_rt_std", 0)
    shots = c("triggerbot_total_shots_analyzed") >= cfg.trigger_min_shots

    def simple(name, when, factor, cheat, rage=False, bare=False):
        pill = cheat if bare else _t("[", cheat, "]")
        return Rule(name, when, factor, cheat, (pill,), rage)

    return [
        simple("RUL-1", c("aim_p99") > cfg.snap_threshold,
               _t("Snap instantané anormal (", snap, "°/tick)"), _t("AIMBOT: Snap ", snap, "°/tick")),
        simple("RUL-2", c("aim_jerk_max") > cfg.jerk_threshold,
               _t("À-coups mécaniques suspects (", jerk, ")"), _t("AIMBOT: Jerk ", jerk)),
        simple("RUL-3", (c("bhop_ratio_parfaits") > cfg.script_ratio) & (c("bhop_total_sauts") >= cfg.script_min_jumps),
               _t("Bhop scripté (", ratio1, "% parfaits)"), _t("BHOP: Script ", ratio0, "%")),
        Rule("RUL-4", c("bhop_chaine_max") >= cfg.chain_flag,
             _t("Chaîne de BunnyHop suspecte (", chain, " consécutifs)"), _t("BHOP: Chaîne ", chain),
             (_t("[BHOP: Chaîne x", chain, "]"),)),
        Rule("RUL-5", (c("wh_ratio_lock_strict") > cfg.esp_strict_ratio)
             & (c("wh_tracking_consecutif_max") >= cfg.esp_strict_run),
             _t("Alignement occlus suspect (", strict, "%)"), _t("INFO-ESP: ", run, " Locks"),
             (_t("[INFO-ESP: ", strict, "% Lock Non-Vu]"), _t("[WALLHACK: ", strict, "% Lock Mur]"))),
        Rule("RUL-6", c("wh_tracking_consecutif_max") >= cfg.esp_run,
             _t("Suivi occlus continu anormal (", run, " ticks)"), _t("INFO-ESP: Track ", run, "t"),
             (_t("[INFO-ESP: Track ", run, " ticks]"), _t("[WALLHACK: Track ", run, " ticks]"))),
        simple("RUL-7", (c("spinbot_yaw_speed_max") > cfg.spin_speed) | (c("spinbot_yaw_spin_windows") > 0),
               _t("Rotation spinbot violente (", spin, "°/tick)"), _t("SPINBOT: Spin ", spin, "°/tick"), rage=True),
        simple("RUL-8", c("spinbot_pitch_violations") > 0, F.lit("Pitch anti-aim hors limites Source 2"),
               F.lit("[ANTI-AIM: Pitch invalide]"), rage=True, bare=True),
        simple("RUL-9", c("spinbot_jitter_score") > cfg.jitter_variance, F.lit("Jitter anti-aim détecté"),
               F.lit("[ANTI-AIM: Jitter]"), bare=True),
        simple("RUL-10", c("spinbot_desync_max_ticks") >= cfg.desync_run,
               _t("Oscillation anti-aim (", flips, " flips)"), _t("[ANTI-AIM: Flip ", flips, "t]"), bare=True),
        simple("RUL-11", shots & (c("triggerbot_rt_median") < cfg.reaction_median_ms),
               _t("Latence alignement-tir anormalement basse (", med1, "ms)"), _t("TRIGGERBOT: Réaction ", med0, "ms")),
        simple("RUL-12", shots & (c("triggerbot_rt_std") < cfg.reaction_std_ms),
               _t("Régularité de tir statistiquement anormale (σ ", std1, "ms)"),
               _t("TRIGGERBOT: Régularité ", std0, "ms")),
        simple("RUL-13", c("triggerbot_burst_count") >= 1,
               _t("Rafales triggerbot instantanées (", bursts, "x)"), _t("TRIGGERBOT: Burst x", bursts)),
    ]


def with_flags(metrics: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Adds factors, cheats, pills (arrays in rule order) and rage. Every rule that fires contributes its texts."""
    hits = F.filter(F.array(*[r.column() for r in rules(cfg)]), lambda x: x.isNotNull())
    return metrics.withColumn("_hits", hits).withColumns({
        "factors": F.transform("_hits", lambda h: h["factor"]),
        "cheats": F.transform("_hits", lambda h: h["cheat"]),
        "pills": F.flatten(F.transform("_hits", lambda h: h["pills"])),
        "rage": F.exists("_hits", lambda h: h["rage"]),
    }).drop("_hits")


def rule_hits(metrics: DataFrame, cfg: AnalysisConfig = DEFAULT, only: str | None = None) -> DataFrame:
    """One row per (player, rule) that fired."""
    cols = [r.column() for r in rules(cfg) if only in (None, r.name)]
    hits = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return metrics.select("match_id", "steamid", F.inline(hits))


def with_thresholds(df: DataFrame, model: DataFrame | None = None, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """High and suspect threshold in percent: from the one-row model metadata, else from the settings."""
    high, suspect = F.lit(cfg.threshold_high), F.lit(cfg.threshold_suspect)
    if model is None:
        return df.withColumns({"threshold_high": high * 100.0, "threshold_suspect": suspect * 100.0})
    meta = one_row(model.select(F.coalesce("threshold_high", "threshold").alias("high"), F.col("threshold_suspect").alias("suspect")))
    return df.withColumns({"threshold_high": F.coalesce(meta["high"], high) * 100.0,
                           "threshold_suspect": F.coalesce(meta["suspect"], suspect) * 100.0})


def with_score(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Needs ml_score (0..100), factors, rage and thresholds. A null or NaN score is not known: rules may still decide, else there is no
    score."""
    n = F.size("factors")
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0.0
            for c in ("aim_vitesse_max", "aim_p99", "bhop_total_sauts", "wh_ratio_lock_strict")]
    inactive = zero[0] & zero[1] & zero[2] & zero[3]
    high, suspect, ml = F.col("threshold_high"), F.col("threshold_suspect"), F.nanvl(F.col("ml_score").cast("double"), F.lit(None).cast("double"))
    raw = (F.when(F.col("rage"), F.greatest(ml, F.lit(90.0), high))
           .when(n >= cfg.factors_cheater, F.greatest(ml, F.lit(75.0), high))
           .when(n >= cfg.factors_suspect, F.greatest(ml, F.lit(45.0), suspect))
           .when(inactive & ml.isNotNull(), F.least(ml, F.lit(5.0))).otherwise(ml))
    return df.withColumn("_raw_score", raw)


def with_verdict(df: DataFrame, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Score rounded to two digits and verdict; a player without a score or without all three core profiles gets UNAVAILABLE."""
    n, s = F.size("factors"), F.col("_raw_score")
    verdict = (F.when(F.col("rage") | (s >= F.col("threshold_high")) | (n >= cfg.factors_cheater), "CHEATER")
               .when((n >= cfg.factors_suspect) | (s >= F.col("threshold_suspect")), "SUSPECT").otherwise("CLEAN"))
    known = s.isNotNull()
    for c in ("aim_p99", "bhop_total_sauts", "wh_ratio_lock_strict"):
        known = known & F.col(c).isNotNull()
    return df.withColumns({
        "suspicion_score": F.when(known, stable_round(s, 2)).otherwise(0.0),
        "verdict": F.when(known, verdict).otherwise("UNAVAILABLE"),
        "analysis_status": F.when(known, "ok").otherwise("insufficient_data"),
    }).drop("_raw_score")


def normalize_result(df: DataFrame) -> DataFrame:
    """Clamp the score and settle verdict / status / quality; trouble never becomes CLEAN."""
    v = F.upper(F.trim(F.coalesce("verdict", F.lit(""))))
    st = F.lower(F.trim(F.coalesce("analysis_status", F.lit("ok"))))
    quality = F.col("data_quality") if "data_quality" in df.columns else F.lit("good")
    known = v.isin("CLEAN", "SUSPECT", "CHEATER")
    error = (v == "ERROR") | (st == "error")
    missing = v.isin("INSUFFICIENT_DATA", "INDISPONIBLE") | (st == "insufficient_data")
    return df.withColumns({
        "suspicion_score": F.least(F.greatest(F.coalesce("suspicion_score", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)),
        "verdict": F.when(error, "ERROR").when(missing, "INSUFFICIENT_DATA").when(known, v).otherwise("ERROR"),
        "analysis_status": F.when(error, "error").when(missing, "insufficient_data").when(known, "ok").otherwise("error"),
        "data_quality": F.when(error | missing | ~known, "insufficient").otherwise(quality),
    })


def score_map(score) -> Column:
    s = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(100.0))
    return F.struct(
        (100.0 - s).alias("clean"), s.alias("suspicion"), (100.0 - s).alias("CLEAN_score"),
        F.when((s >= 35) & (s < 70), s).otherwise(0.0).alias("SUSPECT_score"),
        F.when(s >= 70, s).otherwise(0.0).alias("HIGH_SUSPICION"))


def display_band(verdict="verdict", score="suspicion_score") -> Column:
    v, s = F.upper(F.coalesce(F.col(verdict), F.lit(""))), F.col(score)
    return F.when((v == "CHEATER") | (s >= 80), "CHEATER").when((v == "SUSPECT") | (s >= 40), "SUSPECT").otherwise("CLEAN")


def band_label(band) -> Column:
    return (F.when(F.col(band) == "CHEATER", "SUSPICION ÉLEVÉE").when(F.col(band) == "SUSPECT", "COMPORTEMENT SUSPECT")
            .otherwise("NON DÉTECTÉ"))


def score_band(score="suspicion_score") -> Column:
    s = F.col(score)
    return F.when(s < 40, "clean").when(s < 80, "suspect").otherwise("cheater")


# fixed values: words that place a flag in a category; the first category that matches wins
CATEGORY_WORDS = (
    ("aim", ("AIMBOT", "SNAP", "JERK")),
    ("esp", ("WALLHACK", "LOCK", "ESP")),
    ("bhop", ("BHOP", "SAUT")),
    ("spin", ("SPIN", "PITCH")),
    ("trigger", ("TRIGGER", "RÉACTION", "REACTION")),
    ("critical", ("CRITIQUE", "RAGE")),
)


def flag_category(flag: Column) -> Column:
    f = F.upper(flag)

    def any_of(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(f, F.lit(w))
        return hit

    (name, words), *rest = CATEGORY_WORDS
    out = F.when(any_of(words), name)
    for name, words in rest:
        out = out.when(any_of(words), name)
    return out.otherwise("other")


# fixed values per diagnostic card: words of a critical and of a suspect state (all words of one inner group must occur)
CARDS = (
    ("aim", (("AIMBOT",),), (("JERK",),)),
    ("esp", (("WALLHACK",), ("INFO-ESP",), ("LOCK",)), (("TRACK",),)),
    ("bhop", (("BHOP", "SCRIPT"),), (("BHOP",), ("CHAÎNE",))),
    ("spin", (("SPINBOT",), ("PITCH",), ("ANTI-AIM",)), (("JITTER",),)),
    ("trigger", (("TRIGGER",),), ()),
)


def diagnostics(df: DataFrame, flags: str = "pills") -> DataFrame:
    """One row per player and card: critical, suspect or conform (case-insensitive over the short flags)."""
    text = F.upper(F.array_join(F.col(flags), " "))

    def match(groups):
        hit = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(text, F.lit(w))
            hit = hit | every
        return hit

    cards = F.array(*[
        F.struct(F.lit(name).alias("card"),
                 F.when(match(crit), "critical").when(match(sus), "suspect").otherwise("conform").alias("state"))
        for name, crit, sus in CARDS])
    return df.select("match_id", "steamid", F.inline(cards))


def verdict_summary(flags: str = "factors") -> Column:
    """One French sentence on why the verdict was given."""
    c = F.col
    strict, ratio = c("wh_ratio_lock_strict") * 100.0, c("bhop_ratio_parfaits") * 100.0

    def reason(cond, *parts):
        return F.when(cond, _t(*parts))

    hard = F.concat_ws(
        ", ",
        reason(c("aim_p99") > 25.0, "Snap robotique violent de ", fixed("aim_p99"), "°/tick"),
        reason(strict > 10.0, "Tracking occlus (", fixed(strict), "% locks à travers les murs)"),
        reason(ratio > 60.0, "Script de BunnyHop (", fixed(ratio, 0), "% sauts parfaits en 1 tick)"))
    soft = F.concat_ws(
        ", ",
        reason(c("aim_p99") > 15.0, "Flick angulaire de ", fixed("aim_p99"), "°/tick à la limite humaine"),
        reason(c("bhop_chaine_max") >= 3, "Chaîne de ", _n("bhop_chaine_max"), " sauts synchronisés"))
    first_two = F.array_join(F.slice(F.col(flags), 1, 2), " | ")
    return (F.when(c("verdict") == "CHEATER",
                   F.when((hard == "") & (F.size(flags) > 0), first_two)
                   .otherwise(_t("Triche avérée : ", F.when(hard == "", "Anomalies biomécaniques multiples détectées.")
                                 .otherwise(hard))))
            .when(c("verdict") == "SUSPECT",
                  _t("Anomalies à vérifier : ", F.when(soft == "", "Mouvements atypiques au-dessus des moyennes pros.")
                     .otherwise(soft)))
            .otherwise("✓ Visée humaine naturelle, accélération fluide, aucun lock à travers les murs ni script de saut."))
