"""Report texts as projections. Templates are fixed values; {names} are filled with columns."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.functions.text import FACEIT_PROFILE, STEAM_PROFILE, fixed, profile_url, ratio_to_percent
from tickscope.operators.blocks import PLAYER
from tickscope.operators.results import first_events

PROOF = """=== DOSSIER DE PREUVES TÉLÉMÉTRIQUES // {name} ===
Joueur suspecté : {name}
SteamID64 : {steamid}
Verdict IA : {verdict} (Score de suspicion : {score}%)
Contexte : Carte {map} | Démo : {demo}

1. CINÉTIQUE DE VISÉE (AIMBOT TELEMETRY) :
  • Vitesse angulaire 99e percentile : {p99}°/tick
  • Vitesse angulaire brute max  : {speed_max}°/s
  • Jerk angulaire max           : {jerk_max} (Moyen : {jerk_mean})

2. CINÉTIQUE DE DÉPLACEMENT (BUNNYHOP TELEMETRY) :
  • Ratio de sauts 1-tick au sol : {ratio}% sur {jumps} sauts
  • Chaîne maximale de sauts     : {chain} sauts consécutifs
  • Vitesse moyenne en l'air     : {jump_speed} u/s

3. ALIGNEMENT GÉOMÉTRIQUE 3D (WALLHACK / ESP TELEMETRY) :
  • Lock strict à travers murs   : {strict}% des ticks ennemis masqués
  • Lock étendu à travers murs   : {wide}%
  • Suivi dynamique continu max  : {run} ticks consécutifs
  • Distance moyenne des verrous : {distance} unités Source 2

{events}"""
PROOF_EVENTS = "4. EXTRAITS DES TICKS INCIDENTS RÉPERTORIÉS :\n"
PROOF_NO_EVENTS = "4. ÉVÉNEMENTS SPÉCIFIQUES : Aucun micro-incident isolé."
PROOF_LINES = {
    "aim_snap": "  - [Tick {tick}] SNAP DE VISÉE : {snap}°/tick (Jerk: {jerk}, Arme: {weapon})",
    "bhop_chain": "  - [Ticks {start}-{end}] ENCHAÎNEMENT BHOP : {length} sauts parfaits (Vitesse: {speed} u/s)",
    "wh_lock": "  - [Ticks {start}-{end}] LOCK GÉOMÉTRIE : Suivi de {target} ({duration} ticks, {distance} u)",
    None: "  - Événement suspect : {type}",
}

TICKET_FR = """[RAPPORT D'INTÉGRITÉ CS2 - AUDIT BIOMÉCANIQUE OFFICIEL]
Joueur suspecté : {name}
SteamID64 : {steamid}
Profil Steam : {steam_url}
Match / Carte : {map} | Démo : {demo}

DIAGNOSTIC MOTEUR ANTI-CHEAT :
• Indice de suspicion IA : {score}% [{verdict}]
• Facteurs anormaux détectés :
{flags}

OBSERVATIONS EN MATCH :
{observations}

PREUVES TÉLÉMÉTRIQUES OBJECTIVES (Source 2 DemoParser) :
- Vitesse angulaire 99e percentile : {p99}°/tick
- À-coups mécaniques (Jerk max) : {jerk_max}
- Ratio de BunnyHop parfait 1-tick : {ratio}% sur {jumps} sauts (Chaîne max : {chain})
- Lock de visée à travers les murs (alignement cible non visible) : {strict}% du temps caché
- Suivi continu à travers géométrie : {run} ticks consécutifs{events}

Commentaires de l'auditeur :
{comment}

Généré via {generator} (Local Biomechanical Analysis)."""
TICKET_FR_EVENTS = "\nINCIDENTS MARQUANTS RÉPERTORIÉS :\n"
TICKET_FR_LINES = {
    "aim_snap": "  - Tick {tick}: Snap {snap}°/tick [{weapon}]",
    "bhop_chain": "  - Ticks {start}-{end}: Chaîne de {length} sauts 1-tick",
    "wh_lock": "  - Ticks {start}-{end}: Suivi masqué de {target} ({duration} ticks)",
}
TICKET_FR_EMPTY = {"flags": "  • Aucune anomalie critique automatique (Comportement intègre)",
                   "observations": "• Aucune observation manuelle sélectionnée",
                   "comment": "Aucun commentaire additionnel fourni."}

TICKET_EN = """=== FACEIT SUSPECT TELEMETRY REPORT / AC TICKET ===
Suspect Nickname: {name}
Suspect SteamID64: {steamid}
FaceitFinder: {faceit_url}
Match Map: {map}
Replay File: {demo}

1. VIOLATION CATEGORY:
{observations}

2. QUANTITATIVE BIOMECHANICAL AUDIT:
- Score de Suspicion: {score}% ({verdict})
- 99th Percentile Angular Velocity: {p99} deg/tick
- Angular Jerk Index: {jerk_max} (Mean: {jerk_mean})
- Perfect 1-Tick Ground Jump Transition: {ratio}% on {jumps} jumps (Max Chain: {chain})
- Proxy occlusion alignment: {strict}% of unspotted ticks
- Continuous Occluded Target Tracking: {run} consecutive ticks (Avg Distance: {distance} units){events}

3. SYSTEM FLAGS:
{flags}

4. AUDITOR CONTEXT:
{comment}

Ticket generated automatically via {generator}."""
TICKET_EN_EVENTS = "\nEVIDENCE TICKS LOG:\n"
TICKET_EN_LINES = {
    "aim_snap": "  - Tick {tick}: Snap {snap} deg/tick [{weapon}]",
    "bhop_chain": "  - Ticks {start}-{end}: Chained {length} 1-tick jumps",
    "wh_lock": "  - Ticks {start}-{end}: Occluded target lock on {target} ({duration} ticks)",
}
TICKET_EN_EMPTY = {"flags": "• No automated critical flags (Legitimate profile)",
                   "observations": "• Unspecified / Telemetry flag investigation", "comment": "None provided."}

DIAGNOSTIC = """==================================================
       {title} : RAPPORT DE DIAGNOSTIC
==================================================
Date de l'export : {date}
Démo analysée    : {demo}
--------------------------------------------------
JOUEUR : {name}
STEAM ID : {steamid}
VERDICT GLOBAL : {verdict} ({score}%)
--------------------------------------------------
ANOMALIES ET SIGNAUX TÉLÉMÉTRIQUES (FLAGS):
{flags}
--------------------------------------------------
Rapport généré automatiquement par le modèle ML d'analyse CS2.
=================================================="""
DIAGNOSTIC_EMPTY = "  > Aucune anomalie critique détectée."


def render(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _whole(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long").cast("string")


def _num(x) -> Column:
    return fixed(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0)))


def player_values(df: DataFrame) -> dict[str, Column]:
    def known(c, default):
        return F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)

    return {
        "name": F.col("name"), "steamid": F.col("steamid"), "verdict": F.col("verdict"), "score": _num("suspicion_score"),
        "map": known("map_name", "Inconnue"), "demo": known("demo_filename", "demo_inconnue.dem"),
        "p99": _num("aim_p99"), "speed_max": _num("aim_vitesse_max"), "jerk_max": _num("aim_jerk_max"),
        "jerk_mean": _num("aim_jerk_moyen"), "ratio": _num(ratio_to_percent("bhop_ratio_parfaits")),
        "jumps": _whole("bhop_total_sauts"), "chain": _whole("bhop_chaine_max"), "jump_speed": _num("bhop_vitesse_moyenne"),
        "strict": _num(ratio_to_percent("wh_ratio_lock_strict")), "wide": _num(ratio_to_percent("wh_ratio_lock_cache")),
        "run": _whole("wh_tracking_consecutif_max"), "distance": _num("wh_distance_moyenne_verrous"),
        "steam_url": profile_url("steamid", STEAM_PROFILE), "faceit_url": profile_url("steamid", FACEIT_PROFILE),
    }


def event_line(lines: dict, no_weapon: str = "N/A", no_target: str = "Ennemi") -> Column:
    """Text of one event row; null for kinds the report does not show."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    v = {"tick": text("tick"), "start": text("start_tick"), "end": text("end_tick"), "snap": _num("snap_angle"),
         "jerk": _num("jerk"), "weapon": F.coalesce("weapon", F.lit(no_weapon)), "length": text("chain_length"),
         "speed": _num("avg_speed"), "target": F.coalesce("target_name", F.lit(no_target)),
         "duration": text("duration_ticks"), "distance": _num("distance"), "type": F.col("type")}
    out = None
    for kind, template in lines.items():
        if kind is not None:
            cond = F.col("type") == kind
            out = F.when(cond, render(template, v)) if out is None else out.when(cond, render(template, v))
    return out.otherwise(render(lines[None], v)) if None in lines else out


def with_event_text(players: DataFrame, events: DataFrame, n: int, lines: dict, head: str, none: str,
                    **absent: str) -> DataFrame:
    """Adds ``_events``: the lines of the first n events of a player (a group is at most n rows)."""
    rows = first_events(events, n).select(*PLAYER, "seq", event_line(lines, **absent).alias("line")).where("line is not null")
    g = rows.groupBy(*PLAYER).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    return players.join(g, [*PLAYER], "left").withColumn(
        "_events", F.when(F.col("_lines").isNull(), none).otherwise(F.concat(F.lit(head), F.col("_lines")))).drop("_lines")


def _bullets(c: str, bullet: str, empty: str) -> Column:
    return F.when(F.size(F.col(c)) > 0, F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(bullet), x)), "\n")
                  ).otherwise(empty)


def telemetry_proof(players: DataFrame, events: DataFrame) -> DataFrame:
    d = with_event_text(players, events, 8, PROOF_LINES, PROOF_EVENTS, PROOF_NO_EVENTS, no_weapon="inconnu")
    return d.withColumn("report", render(PROOF, player_values(d) | {"events": F.col("_events")})).drop("_events")


def _ticket(players, events, template, lines, head, empty, flag_bullet, generator) -> DataFrame:
    d = with_event_text(players, events, 5, lines, head, "", no_target="target")
    none = F.array().cast("array<string>")
    if "observations" not in d.columns:
        d = d.withColumn("observations", none)
    if "comment" not in d.columns:
        d = d.withColumn("comment", F.lit(""))
    v = player_values(d) | {
        "events": F.col("_events"), "generator": F.lit(generator),
        "flags": _bullets("factors", flag_bullet, empty["flags"]),
        "observations": _bullets("observations", "• ", empty["observations"]),
        "comment": F.when(F.coalesce("comment", F.lit("")) == "", empty["comment"]).otherwise(F.trim("comment"))}
    return d.withColumn("report", render(template, v)).drop("_events")


def ticket_fr(players: DataFrame, events: DataFrame, generator="tickscope") -> DataFrame:
    return _ticket(players, events, TICKET_FR, TICKET_FR_LINES, TICKET_FR_EVENTS, TICKET_FR_EMPTY, "  • ", generator)


def ticket_en(players: DataFrame, events: DataFrame, generator="tickscope") -> DataFrame:
    return _ticket(players, events, TICKET_EN, TICKET_EN_LINES, TICKET_EN_EVENTS, TICKET_EN_EMPTY, "• ", generator)


def diagnostic(players: DataFrame, date: Column, title="TELEMETRY") -> DataFrame:
    v = player_values(players) | {"title": F.lit(title), "date": date, "flags": _bullets("factors", "  > ", DIAGNOSTIC_EMPTY)}
    return players.withColumn("report", render(DIAGNOSTIC, v))


def match_lines(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Console summary as rows: a head line, one line per player, the verdict."""
    head = render("Carte: {m} | Ticks: {t} | Joueurs: {n}", {
        "m": F.coalesce("map_name", F.lit("None")) if "map_name" in matches.columns else F.lit("None"),
        "t": F.col("total_ticks").cast("string"), "n": F.col("players").cast("string")})
    tail = render("Verdict global: {v}", {"v": F.col("global_verdict")})
    a = matches.select("match_id", F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("").alias("steamid"), head.alias("line")),
        F.struct(F.lit(2).alias("part"), F.lit("").alias("steamid"), tail.alias("line")))))
    v = player_values(players) | {"flags": F.array_join("factors", "; ")}
    b = players.select("match_id", F.lit(1).alias("part"), "steamid",
                       render("  {name} [{steamid}] {verdict} {score}% - {flags}", v).alias("line"))
    return a.unionByName(b)
