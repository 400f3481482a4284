"""Dataset side: manifest, sampling, splits, labels, features."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.config import DEFAULT
from tickscope.functions.frames import one_row
from tickscope.operators.blocks import PLAYER, block_index

# fixed values: the ordered feature list, its version and the name it replaced
FEATURES = (
    "aim_vitesse_max", "aim_p99", "aim_jerk_moyen", "aim_jerk_max", "aim_ratio_micro_ajustements", "aim_variance_vitesse",
    "bhop_total_sauts", "bhop_ratio_parfaits", "bhop_variance_sol", "bhop_chaine_max", "bhop_vitesse_moyenne",
    "wh_ratio_lock_cache", "wh_ratio_lock_strict", "wh_tracking_consecutif_max", "wh_distance_moyenne_verrous",
)
FEATURE_VERSION = "1.0"
FEATURE_ALIASES = {"aim_snap_max": "aim_p99"}

# fixed values: class folders and what their labels are worth
WITH, WITHOUT = "with_cheater_present", "no_cheater_present"
SOURCE_WITH, SOURCE_WITHOUT = "cs2cd_vac_verified", "cs2cd_unverified_no_vac"


def schema_hash(names=FEATURES) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()[:16]


def schema_hash_column(names: Column) -> Column:
    """The same for a column that holds the names."""
    return F.substring(F.sha2(F.array_join(names, ","), 256), 1, 16)


def canonical_features(df: DataFrame) -> DataFrame:
    for old, new in FEATURE_ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def build_manifest(pairs: DataFrame, cheaters: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """Paired files with labels. ``cheaters``: (match_category, base, steamid); ``corrupt``: (match_category, base)."""
    m = pairs.where("status = 'paired'").where(F.col("match_category").isin(WITH, WITHOUT))
    if corrupt is not None:
        m = m.join(corrupt.select("match_category", "base").distinct(), ["match_category", "base"], "left_anti")
    # the manifest format holds the verified players of a match in one text field
    ids = cheaters.where(F.col("match_category") == WITH).distinct().groupBy("match_category", "base").agg(
        F.array_sort(F.collect_set("steamid")).alias("_ids"))
    m = m.join(ids, ["match_category", "base"], "left").withColumn(
        "_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    positive = F.col("match_category") == WITH
    return m.select(
        F.concat_ws("_", "match_category", "base").alias("match_id"), "match_category", "data_path", "metadata_path",
        F.col("match_category").alias("label"),
        F.when(~positive, "medium").when(F.size("_ids") > 0, "high").otherwise("uncertain").alias("label_confidence"),
        F.when(positive, SOURCE_WITH).otherwise(SOURCE_WITHOUT).alias("label_source"),
        F.array_join("_ids", ",").alias("cheaters"), F.size("_ids").alias("num_cheaters"),
        F.lit(True).alias("usable_for_training"))


def pairing_stats(pairs: DataFrame, manifest: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """One row of counts over the pairing and the manifest."""
    def n(s):
        return F.count_if(F.col("status") == s)

    counts = pairs.agg(F.count("data_path").alias("scanned"), F.sum("parquet_files").alias("parquet_files"),
                  F.sum("csv_gz_files").alias("csv_gz_files"), F.count("metadata_path").alias("json_files"),
                  n("missing_json").alias("missing_json"), n("orphan_json").alias("orphan_json"))
    with_ = F.col("label") == WITH
    m = manifest.agg(F.count(F.lit(1)).alias("valid_matches"), F.count_if(with_).alias("with_cheater"),
                     F.count_if(~with_).alias("no_cheater"), F.coalesce(F.sum("num_cheaters"), F.lit(0)).alias("cheater_ids"))
    out = counts.withColumn("_m", one_row(m)).select(*counts.columns, "_m.*")
    if corrupt is not None:
        c = corrupt.select("match_category", "base").distinct().agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumn("corrupt_json", one_row(c)["n"])
    return out


def shuffled_rank(df: DataFrame, keys: list[str], seed: int = DEFAULT.seed, key: str = "match_id") -> DataFrame:
    """Deterministic random order: ``r_i`` of ``r_n`` within ``keys`` by a hash, ranked block by block of hash prefix."""
    d = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))))
    block = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    return block_index(d, {"r": F.lit(1)}, keys, ("_h", key), block=block).drop("_h")


def balanced_sample(manifest: DataFrame, n: int, seed: int = DEFAULT.seed) -> DataFrame:
    """Up to n/2 matches with cheaters, the rest without; everything if there are no more than ``n``."""
    d = shuffled_rank(manifest, ["label"], seed)
    have = one_row(manifest.agg(F.count_if(F.col("label") == WITH).alias("with"), F.count(F.lit(1)).alias("all")))
    quota = F.least(F.lit(n // 2), have["with"])
    chosen = F.when(F.col("label") == WITH, F.col("r_i") <= quota).otherwise(F.col("r_i") <= F.lit(n) - quota)
    return d.where((have["all"] <= n) | chosen).select(*manifest.columns)


def split_matches(manifest: DataFrame, seed: int = DEFAULT.seed) -> DataFrame:
    """70 / 15 / 15 by match, per label if every label has two matches and there are six, else over all."""
    per_label = manifest.groupBy("label").count()
    size = one_row(per_label.agg(F.sum("count").alias("total"), F.min("count").alias("least")))
    d = manifest.drop("split").withColumns({"_total": size["total"], "_least": size["least"]})
    d = d.withColumn("_stratum", F.when((F.col("_total") >= 6) & (F.col("_least") >= 2), F.col("label")).otherwise("all"))
    d = shuffled_rank(d, ["_stratum"], seed)
    held = F.ceil(F.col("r_n") * 0.30)
    test = F.ceil(held / 2)
    split = (F.when(F.col("_total") < 3, "train").when(F.col("r_i") <= F.col("r_n") - held, "train")
             .when(F.col("r_i") <= F.col("r_n") - test, "validation").otherwise("test"))
    return d.withColumn("split", split).select(*[c for c in manifest.columns if c != "split"], "split")


def label_players(players: DataFrame, manifest: DataFrame, cheaters: DataFrame) -> DataFrame:
    """1 verified, 0 from a match without cheaters, -1 unknown: a stranger in a cheater's match is not clean.

    ``cheaters``: (match_id, steamid) rows, so membership is an equi-join.
    """
    m = manifest.select("match_id", "match_category", "split")
    hit = cheaters.select(*PLAYER).distinct().withColumn("_hit", F.lit(True))
    d = players.join(m, "match_id").join(hit, [*PLAYER], "left")
    label = (F.when((F.col("match_category") == WITH) & F.col("_hit"), 1)
             .when(F.col("match_category") == WITHOUT, 0).otherwise(-1))
    d = d.withColumn("label", label).drop("_hit")
    return d.withColumns({
        "player_key": F.concat_ws("_", "match_id", "steamid"),
        "label_text": F.when(F.col("label") == 1, "verified_cheater").when(F.col("label") == 0, "probable_non_cheater")
        .otherwise("unknown"),
        "label_confidence": F.when(F.col("label") == 1, "high").when(F.col("label") == 0, "medium").otherwise("low"),
        "usable_for_training": F.col("label").isin(0, 1),
    })


def feature_rows(aim: DataFrame, bhop: DataFrame, occlusion: DataFrame) -> DataFrame:
    """Fifteen ordered doubles per player; a missing profile stays null and fails at assembly instead of becoming 0."""
    d = aim.join(bhop, [*PLAYER], "full").join(occlusion, [*PLAYER], "full")
    return d.select(*PLAYER, *[F.col(f).cast("double").alias(f) for f in FEATURES])


def population(features: DataFrame) -> DataFrame:
    return features.groupBy("split", "label").count()


def supervised(features: DataFrame, split: str | None = None) -> DataFrame:
    d = features.where("usable_for_training")
    return d if split is None else d.where(F.col("split") == split)
