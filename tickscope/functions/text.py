"""Text and display expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickscope.functions.angles import _c

STEAM_PROFILE = "https://steamcommunity.com/profiles/"
FACEIT_PROFILE = "https://faceitfinder.com/profile/"


def fixed(x, digits: int = 1) -> Column:
    """Fixed decimals, ties on the exact binary value go to even (as C and Python print numbers)."""
    return F.translate(F.format_number(_c(x).cast("double"), digits), ",", "")


def is_steam_id(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^[0-9]{17}$"), F.lit(False))


def steamid64(x) -> Column:
    return F.when(is_steam_id(x), _c(x))


def is_anonymized(x) -> Column:
    return ~is_steam_id(x) | F.coalesce(F.startswith(_c(x), F.lit("Player_")), F.lit(False))


def profile_url(x, base: str = STEAM_PROFILE) -> Column:
    s = F.trim(_c(x))
    return F.when(is_steam_id(s), F.concat(F.lit(base), s)).otherwise("")


def ratio_to_percent(x) -> Column:
    """0..1 is a ratio; anything else already is a percentage."""
    x = _c(x)
    return F.when((x > 0) & (x <= 1), x * 100.0).otherwise(x)


def size_mb(size) -> Column:
    return F.round(_c(size) / F.lit(1048576.0), 2)


def readable_size(size) -> Column:
    s = _c(size).cast("double")
    return (F.when(s < 1024, F.concat(_c(size).cast("long").cast("string"), F.lit(" B")))
            .when(s < 1024**2, F.concat(fixed(s / 1024.0), F.lit(" KB")))
            .when(s < 1024**3, F.concat(fixed(s / float(1024**2)), F.lit(" MB")))
            .otherwise(F.concat(fixed(s / float(1024**3), 2), F.lit(" GB"))))


def iso_time(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def team_label(team) -> Column:
    return F.when(_c(team) == 3, "CT").when(_c(team) == 2, "T").otherwise("SPEC")


def map_label(name) -> Column:
    return F.upper(F.coalesce(F.when(_c(name) != "", _c(name)), F.lit("Carte Inconnue")))


def server_label(name) -> Column:
    return F.when((_c(name) != "") & (_c(name) != "unknown"), _c(name)).otherwise("Serveur CS2")


def replay_context(map_name, server_name, name, path) -> Column:
    """struct(map_name, server_name, demo_filename) with the texts reports use for what is unknown."""
    def known(x):
        return F.when(_c(x) != "", _c(x))

    return F.struct(
        F.coalesce(known(map_name), F.lit("Inconnue")).alias("map_name"),
        F.coalesce(known(server_name), F.lit("Serveur Inconnu")).alias("server_name"),
        F.coalesce(known(name), file_name(known(path)), F.lit("demo_inconnue.dem")).alias("demo_filename"))


def duration_label(seconds) -> Column:
    whole = F.floor(_c(seconds)).cast("long")
    return F.format_string("%02dm %02ds", F.expr("0L") + F.floor(whole / 60), whole % 60)


def safe_file_name(name) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(_c(name), F.lit("")), r'[\\/*?:"<>|]', ""))
    return F.when(clean == "", "Joueur_Inconnu").otherwise(clean)
