"""Queries of sources, sinks and streams. Files are written by Spark from the given tables, then read back."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tickscope.functions.numbers import stable_round
from tickscope.operators import results
from tickscope.operators.blocks import PLAYER
from tickscope.plans import dataset
from tickscope.plans import inputs as I
from tickscope.plans.registry import query
from tickscope.plans.registry.learning import K_SQL, LABELS_SQL, MANIFEST_SQL, features, manifest_with_split, match_no
from tickscope.plans.registry.relational import THR_SQL, judged, report_events
from tickscope.plans.registry.scalar import HURT_SQL, hurt
from tickscope.sources import files, heads, sinks
from tickscope.sources import ticks as readers
from tickscope.sources.workdir import new_path
from tickscope.streaming import arrivals


READ_COLUMNS = ("match_id", "status", "missing", *readers.TICK_TYPES)
READ_SQL = I.with_sql(I.BASE_SQL, f"""SELECT match_id, 'accepted' AS status, '' AS missing, tick, steamid, X, Y, Z, round(pitch, 6) AS pitch, round(yaw, 6) AS yaw,
    steamid AS name, team_num, health, CASE WHEN {K_SQL} % 5 <> 3 THEN spotted END AS spotted, is_airborne, velocity_X, velocity_Y,
    CAST(NULL AS DOUBLE) AS velocity_Z, CAST(NULL AS VARCHAR) AS active_weapon_name, CAST(event_id % 4 AS INTEGER) AS shots_fired, event_id % 6 = 0 AS is_firing FROM ticks WHERE {K_SQL} % 5 <> 4
  UNION ALL SELECT DISTINCT match_id, 'rejected', 'yaw', CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM ticks WHERE {K_SQL} % 5 = 4""")


def raw_ticks(spark, sf):
    t = I.ticks(spark, sf).withColumns({"shots_fired": F.expr("cast(event_id % 4 as int)"), "is_firing": F.col("event_id") % 6 == 0})
    return t.drop("event_id", "name", "active_weapon_name")


def write_variants(spark, sf, path):
    """Parquet as it occurs: 64-bit integers and ids stored as numbers, doubles for whole numbers, an absent optional column with a
    foreign one, and matches without yaw, each kind in files of its own."""
    t, k = raw_ticks(spark, sf), match_no() % 5
    number = F.col("steamid").rlike("^[0-9]+$")
    wide = t.where(k == 0).withColumns({c: F.col(c).cast("long") for c in ("team_num", "health")})
    wide.where(number).withColumn("steamid", F.col("steamid").cast("long")).write.parquet(path + "/a")
    wide.where(~number).write.parquet(path + "/b")
    t.where(k == 1).withColumns({c: F.col(c).cast("double") for c in ("tick", "health")}).write.parquet(path + "/c")
    t.where(k == 2).write.parquet(path + "/d")
    t.where(k == 3).drop("spotted").withColumn("ping", F.lit(7)).write.parquet(path + "/e")
    t.where(k == 4).drop("yaw").write.parquet(path + "/f")


def write_csv_variants(spark, sf, path):
    """Two orders of the header, an absent optional column, matches without yaw, plain and packed files, and letters of several bytes in a foreign
    column of every length, so that any cut by bytes falls inside some letter."""
    t, k = raw_ticks(spark, sf).withColumn("remark", F.expr("concat('ж', repeat('日本ж', cast(tick % 7 as int)))")), match_no() % 5

    def put(df, name, packing="gzip"):
        df.write.option("header", True).option("compression", packing).csv(f"{path}/{name}")

    put(t.where(k == 0), "a")
    put(t.where(k == 1), "e", "none")
    put(t.where(k == 2).select(*reversed(t.columns)), "b")
    put(t.where(k == 3).drop("spotted").select("yaw", *[c for c in t.columns if c not in ("yaw", "spotted")]), "c", "none")
    put(t.where(k == 4).drop("yaw", "remark"), "d")


def parquet_path(spark, sf):
    return I.stored_path(spark, sf, "raw_ticks", lambda p: write_variants(spark, sf, p))


def _read_back(df):
    """Status of every match with its clean rows; a rejected match is one row without values."""
    clean = readers.clean_ticks(df).drop(*readers.SOURCE).withColumns({c: stable_round(c, 6) for c in ("pitch", "yaw")})
    return readers.match_status(df).join(clean, "match_id", "left").select(*READ_COLUMNS)


@query("SRC-1", READ_SQL)
def src1(spark, sf):
    return _read_back(readers.read_ticks(spark, parquet_path(spark, sf)))


@query("SRC-2", READ_SQL)
def src2(spark, sf):
    return _read_back(readers.read_ticks_csv(spark, I.stored_path(spark, sf, "csv_ticks", lambda p: write_csv_variants(spark, sf, p))))


def event_documents(spark, sf):
    """JSON documents per match, several per match, the first of one match in six cut short."""
    def write(path):
        t = I.ticks(spark, sf)
        chunk = F.expr("tick div 64").alias("chunk")
        f = I.fires(t).groupBy("match_id", chunk).agg(F.collect_list(F.struct("tick", "user_steamid", "user_name", "weapon")).alias("weapon_fire"))
        h = hurt(t).groupBy("match_id", chunk).agg(F.collect_list(F.struct("tick", "attacker_steamid", "user_steamid")).alias("player_hurt"))
        # ids of a chunk: a bounded part of the match
        c = t.where("cast(substring(name, 2) as bigint) % 7 = 0").where(match_no() % 2 == 0).groupBy("match_id", chunk).agg(
            F.array_sort(F.collect_set("steamid")).alias("_c"))
        docs = f.join(h, ["match_id", "chunk"], "full").join(c, ["match_id", "chunk"], "left")
        docs = docs.withColumn("cheaters", F.transform("_c", lambda s: F.struct(s.alias("steamid"))))
        body = F.to_json(F.struct("weapon_fire", "player_hurt", "cheaters"))
        cut = (match_no() % 6 == 5) & (F.col("chunk") == 0)
        docs.select("match_id", F.when(cut, F.substring(body, 1, 40)).otherwise(body).alias("value")).write.partitionBy(
            "match_id").text(path)

    path = I.stored_path(spark, sf, "event_docs", write)
    return readers.read_event_documents(spark, path, multiline=False, match_column=True)


GOOD_EVENTS = f"NOT ({K_SQL} % 6 = 5 AND tick // 64 = 0)"


@query("SRC-3", I.with_sql(I.BASE_SQL, HURT_SQL + f"""
  SELECT match_id, 'weapon_fire' AS event_name, tick, user_steamid AS actor, NULL AS victim, weapon FROM fires WHERE {GOOD_EVENTS}
  UNION ALL SELECT match_id, 'player_hurt', tick, attacker_steamid, user_steamid, NULL FROM hurt WHERE {GOOD_EVENTS}"""))
def src3(spark, sf):
    docs = event_documents(spark, sf).where("_corrupt is null")
    out = readers.explode_events(docs, "weapon_fire").unionByName(readers.explode_events(docs, "player_hurt"))
    return out.select("match_id", "event_name", "tick", "actor", "victim", "weapon")


@query("DST-2", I.with_sql(I.BASE_SQL, f"SELECT DISTINCT match_id FROM ticks WHERE {K_SQL} % 6 = 5 AND tick // 64 = 0 AND active_weapon_name IN ('purchase', 'click')"))
def dst2(spark, sf):
    return readers.corrupt_documents(event_documents(spark, sf))


def manifest_file(spark, sf):
    return I.stored_path(spark, sf, "manifest_csv", lambda p: sinks.write_manifest(manifest_with_split(spark, sf), p))


@query("SRC-4", I.with_sql(MANIFEST_SQL, """SELECT match_id, label, len(ids) AS n, array_to_string(ids, '|') AS ids, split FROM (
  SELECT *, CASE WHEN cheaters = '' THEN [] ELSE string_split(cheaters, ',') END AS ids FROM split_)"""))
def src4(spark, sf):
    m = sinks.read_manifest(spark, manifest_file(spark, sf))
    return m.select("match_id", "label", F.size("cheaters").cast("long").alias("n"), F.array_join("cheaters", "|").alias("ids"), "split")


@query("SNK-1", I.with_sql(MANIFEST_SQL, """SELECT match_id, match_category, data_path, metadata_path, label, label_confidence, label_source,
  nullif(cheaters, '') AS cheaters, num_cheaters, usable_for_training, split FROM split_"""))
def snk1(spark, sf):
    return spark.read.schema(sinks.MANIFEST_SCHEMA).option("header", True).csv(manifest_file(spark, sf)).withColumn(
        "cheaters", F.nullif("cheaters", F.lit("")))


# --- listings ----------------------------------------------------------------------------------------------------

def replay_listing(spark, sf):
    p = I.table(spark, sf, "pages").select("page_id", F.length("html").cast("long").alias("length"))
    i = F.col("page_id")
    name = (F.when(i % 3 == 0, F.concat(F.lit("/replays/m"), i.cast("string"), F.lit("_DE_Map"), (i % 7).cast("string"), F.lit(".dem")))
            .when(i % 3 == 1, F.concat(F.lit("/replays/m"), i.cast("string"), F.lit(".dem")))
            .otherwise(F.concat(F.lit("/replays/m"), i.cast("string"), F.lit(".dem.info"))))
    return p.select("page_id", name.alias("path"), F.timestamp_seconds(F.lit(1700000000) + i * 7919 % 100000).alias("modified_time"), "length")


def info_heads(spark, sf):
    i = F.col("page_id")
    head = F.concat(F.lit("\x01map "), F.when(i % 2 == 0, F.concat(F.lit("cs_office"), (i % 5).cast("string"))).otherwise("none"), F.lit(" end"))
    return I.table(spark, sf, "pages").where(i % 3 == 1).select(
        F.concat(F.lit("/replays/m"), i.cast("string"), F.lit(".dem.info")).alias("path"), F.encode(head, "UTF-8").alias("head"))


@query("SRC-5", """SELECT CASE WHEN page_id % 3 = 0 THEN '/replays/m' || page_id || '_DE_Map' || page_id % 7 || '.dem' ELSE '/replays/m' || page_id || '.dem' END AS path,
  CASE WHEN page_id % 3 = 0 THEN 'm' || page_id || '_DE_Map' || page_id % 7 || '.dem' ELSE 'm' || page_id || '.dem' END AS file_name, length(html) AS length,
  1700000000 + page_id * 7919 % 100000 AS modified_seconds,
  CASE WHEN page_id % 3 = 0 THEN 'de_map' || page_id % 7 WHEN page_id % 2 = 0 THEN 'cs_office' || page_id % 5 END AS map_name,
  row_number() OVER (ORDER BY 1700000000 + page_id * 7919 % 100000 DESC, path) AS position
  FROM pages WHERE page_id % 3 < 2""")
def src5(spark, sf):
    catalog = files.with_position(files.replay_catalog(replay_listing(spark, sf), info_heads(spark, sf)))
    return catalog.select("path", "file_name", "length", F.unix_seconds("modified_time").alias("modified_seconds"), "map_name", "position")


def replay_files(spark, sf):
    """One file per document: four of five kinds begin with the magic of a replay or a wrong one, the fifth is too short."""
    kind = F.col("doc_id") % 5

    def write(path):
        magic = F.decode(F.unhex(F.lit(files.MAGIC_HEX)), "UTF-8")
        wrong = F.decode(F.unhex(F.lit("504244454D533100")), "UTF-8")
        value = F.when(kind == 1, F.concat(wrong, "text")).when(kind == 2, F.lit("PB")).otherwise(F.concat(magic, "text"))
        # a thousand files to a folder
        name = F.concat(F.expr("cast(doc_id div 1000 as string)"), F.lit("/doc_id="), F.col("doc_id").cast("string"), F.lit(".txt"))
        sinks.write_texts(I.table(spark, sf, "documents").select(name.alias("path"), value.alias("value")), path)

    return I.stored_path(spark, sf, "replay_files", write)


def doc_of_path():
    return F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long")


@query("SRC-6", "SELECT doc_id, strlen(text) + 9 AS length FROM documents WHERE doc_id % 5 IN (0, 3, 4)")
def src6(spark, sf):
    """Files that are long enough and begin with the right eight bytes; shorter ones are not opened, and no more of the others is read."""
    found = heads.file_heads(spark, replay_files(spark, sf), "*.txt", 8).where("length >= 8")
    return files.valid_header(found).select(doc_of_path().alias("doc_id"), "length")


def data_listing(spark, sf):
    i = F.col("page_id")
    folder = F.concat(F.lit("/data/"), F.when(i % 4 < 2, dataset.WITH).otherwise(dataset.WITHOUT), F.lit("/"), i.cast("string"))
    ext = F.filter(F.array(F.when(i % 2 == 0, F.lit(".parquet")), F.when(i % 3 != 0, F.lit(".csv.gz")), F.when(i % 5 != 0, F.lit(".json"))),
                   lambda x: x.isNotNull())
    return I.table(spark, sf, "pages").select(folder.alias("f"), F.explode(ext).alias("e")).select(F.concat("f", "e").alias("path"))


PAIR_SQL = """WITH d AS (SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'with_cheater_present' ELSE 'no_cheater_present' END AS match_category,
    page_id % 2 = 0 AS pq, page_id % 3 <> 0 AS gz, page_id % 5 <> 0 AS js FROM pages),
  p AS (SELECT match_category, CAST(page_id AS VARCHAR) AS base, '/data/' || match_category || '/' || page_id AS f, pq, gz, js FROM d WHERE pq OR gz OR js),
  pairs AS (SELECT match_category, base, CASE WHEN pq THEN f || '.parquet' WHEN gz THEN f || '.csv.gz' END AS data_path, CASE WHEN js THEN f || '.json' END AS metadata_path,
    CASE WHEN NOT js THEN 'missing_json' WHEN NOT pq AND NOT gz THEN 'orphan_json' ELSE 'paired' END AS status, pq, gz FROM p)
"""


@query("SRC-7", PAIR_SQL + "SELECT match_category, base, data_path, metadata_path FROM pairs WHERE data_path IS NOT NULL")
def src7(spark, sf):
    return files.discover_pairs(data_listing(spark, sf)).where("data_path is not null").select(
        "match_category", "base", "data_path", "metadata_path")


@query("JOIN-6", PAIR_SQL + "SELECT match_category, base, data_path, metadata_path, status FROM pairs")
def join6(spark, sf):
    return files.discover_pairs(data_listing(spark, sf)).select("match_category", "base", "data_path", "metadata_path", "status")


@query("SET-3", PAIR_SQL + "SELECT match_category, base, metadata_path FROM pairs WHERE status = 'orphan_json'")
def set3(spark, sf):
    return files.discover_pairs(data_listing(spark, sf)).where("status = 'orphan_json'").select("match_category", "base", "metadata_path")


@query("AGG-6", PAIR_SQL + """, c AS (SELECT * FROM pairs WHERE status = 'paired'), v AS (SELECT * FROM c WHERE CAST(base AS BIGINT) % 10 <> 1)
  SELECT (SELECT count(data_path) FROM pairs) AS scanned, (SELECT count(*) FILTER (pq) FROM pairs) AS parquet_files, (SELECT count(*) FILTER (gz) FROM pairs) AS csv_gz_files,
    (SELECT count(metadata_path) FROM pairs) AS json_files, (SELECT count(*) FROM pairs WHERE status = 'missing_json') AS missing_json,
    (SELECT count(*) FROM pairs WHERE status = 'orphan_json') AS orphan_json, (SELECT count(*) FROM v) AS valid_matches,
    (SELECT count(*) FROM v WHERE match_category = 'with_cheater_present') AS with_cheater, (SELECT count(*) FROM v WHERE match_category <> 'with_cheater_present') AS no_cheater,
    (SELECT count(*) FROM v WHERE match_category = 'with_cheater_present' AND CAST(base AS BIGINT) % 3 > 0) * 2 AS cheater_ids,
    (SELECT count(*) FROM c WHERE CAST(base AS BIGINT) % 10 = 1) AS corrupt_json""")
def agg6(spark, sf):
    pairs = files.discover_pairs(data_listing(spark, sf))
    b = F.expr("cast(base as bigint)")
    corrupt = pairs.where("status = 'paired'").where(b % 10 == 1).select("match_category", "base")
    found = pairs.where(b % 3 > 0).select("match_category", "base", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("steamid"))
    return dataset.pairing_stats(pairs, dataset.build_manifest(pairs, found, corrupt), corrupt)


# --- sinks -------------------------------------------------------------------------------------------------------

@query("SNK-2", I.with_sql(LABELS_SQL, """SELECT player_key, match_id, steamid, split, match_category, label,
  CASE label WHEN 1 THEN 'verified_cheater' WHEN 0 THEN 'probable_non_cheater' ELSE 'unknown' END AS label_text,
  CASE label WHEN 1 THEN 'high' WHEN 0 THEN 'medium' ELSE 'low' END AS label_confidence, label IN (0, 1) AS usable_for_training, """ + ", ".join(
    f"round({f}, 6) AS {f}" for f in dataset.FEATURES) + " FROM feats"))
def snk2(spark, sf):
    meta = {"schema_version": dataset.FEATURE_VERSION, "schema_hash": dataset.schema_hash()}
    path = new_path(spark, "features")
    sinks.write_features(features(spark, sf), path, meta)
    return sinks.read_features(spark, path, meta).select(
        "player_key", "match_id", "steamid", "split", "match_category", "label", "label_text", "label_confidence", "usable_for_training",
        *[stable_round(f, 6).alias(f) for f in dataset.FEATURES])


@query("SNK-3", I.with_sql(THR_SQL, """SELECT match_id, steamid, verdict, suspicion_score, len(factors) AS factors, (SELECT count(*) FROM kin k
  WHERE k.match_id = vd.match_id AND k.steamid = vd.steamid AND raw_speed > 120) AS snaps,
  count(*) OVER (PARTITION BY match_id) AS match_players, count(*) FILTER (verdict = 'CHEATER') OVER (PARTITION BY match_id) AS match_cheaters FROM vd"""))
def snk3(spark, sf):
    p = judged(spark, sf)
    m = results.match_verdict(p)
    e = report_events(spark, sf)
    path = new_path(spark, "results")
    sinks.write_results(m, p, e, path, page=10)
    m2, p2, e2 = sinks.read_results(spark, path, m, p, e)
    snaps = e2.groupBy(*PLAYER).agg(F.count_if(F.col("type") == "aim_snap").alias("snaps"))
    heads = m2.select("match_id", F.col("players").alias("match_players"), F.col("cheaters").alias("match_cheaters"))
    return p2.join(snaps, [*PLAYER], "left").join(heads, "match_id").select(
        *PLAYER, "verdict", "suspicion_score", F.size("factors").cast("long").alias("factors"), F.coalesce("snaps", F.lit(0)).alias("snaps"),
        "match_players", "match_cheaters")


@query("SNK-4", I.with_sql(MANIFEST_SQL, """SELECT match_id, label, 'data/raw_examples/' || match_id || '.parquet' AS data_path,
  'data/raw_examples/' || match_id || '.json' AS metadata_path FROM split_ ORDER BY match_id LIMIT 10"""))
def snk4(spark, sf):
    return sinks.example_manifest(manifest_with_split(spark, sf)).select("match_id", "label", "data_path", "metadata_path")


@query("SNK-5", I.with_sql(THR_SQL, """SELECT match_id, 'Report_' || CASE WHEN CAST(substr(name, 2) AS BIGINT) % 10 = 3 THEN 'Joueur_Inconnu' ELSE 'x' || name END || '_' || steamid AS file_name,
  verdict || chr(10) || array_to_string(factors, chr(10)) AS text FROM vd"""))
def snk5(spark, sf):
    who = F.expr("cast(substring(name, 2) as bigint)")
    p = judged(spark, sf).select(
        "match_id", "steamid", F.when(who % 10 == 3, ' ?*<>|"').otherwise(F.concat(F.lit("x:/"), F.col("name"))).alias("name"),
        F.concat_ws("\n", "verdict", F.array_join("factors", "\n")).alias("report"))
    path = new_path(spark, "reports")
    sinks.write_reports(p, path)
    d = spark.read.text(path, wholetext=True)
    return d.select("match_id", "file_name", F.regexp_replace("value", r"\n\z", "").alias("text"))


# --- streams -----------------------------------------------------------------------------------------------------

PLAIN_THR_SQL = I.METRICS_SQL + ",\nsm AS (SELECT * REPLACE (0.0::DOUBLE AS ml_score) FROM metrics)" + THR_SQL.removeprefix(I.SCALED_SQL)


POLL_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@query("STR-1", I.with_sql(PLAIN_THR_SQL, "SELECT match_id, steamid, verdict, suspicion_score, len(factors) AS factors FROM vd"))
def str1(spark, sf):
    """Every match arrives in two parts, each noticed by three polls; after the second part it has the verdicts of the whole."""
    src, polls, out, checkpoint = (new_path(spark, name) for name in ("split_ticks", "polls", "arrivals", "cp"))

    def fires_of(t):
        return t.where("active_weapon_name = 'purchase'").select("match_id", "tick", F.col("steamid").alias("user_steamid"))

    for part in (0, 1):
        I.ticks(spark, sf).where(F.col("tick") % 2 == part).drop("event_id").write.parquet(f"{src}/part{part}")
        for n in range(3):
            arrivals.record_poll(spark, src, polls, "*.parquet", POLL_START + timedelta(seconds=20 * part + n))
        arrivals.analyse_on_arrival(spark, polls, fires_of, out, checkpoint, radius=200.0).awaitTermination()
    return arrivals.latest_results(spark, f"{out}/players").select(
        *PLAYER, "verdict", "suspicion_score", F.size("factors").cast("long").alias("factors"))


@query("STR-2", """SELECT doc_id, strlen(text) + 9 AS length, 'complete' AS outcome FROM documents WHERE doc_id % 5 IN (0, 3)
  UNION ALL SELECT doc_id, 3, 'timeout' FROM documents WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, strlen(text) + 8, 'timeout' FROM documents WHERE doc_id % 5 = 4""")
def str2(spark, sf):
    """One file per document and polls of it over nine seconds, of which five may pass until it is complete: complete from the start, the same with a wrong
    start of the file, too short for ever, growing and then complete, still growing when the time is over. A second run goes on with the state of the first."""
    listed = files.list_tree(spark, replay_files(spark, sf), "*.txt")

    def seen(*polls):
        """(tenths of a second, bytes still missing) of each poll."""
        return F.array(*[F.struct(F.lit(at).alias("at"), F.lit(less).alias("less")) for at, less in polls])

    kind = doc_of_path() % 5
    looks = (F.when(kind == 3, seen((0, 3), (10, 2), (20, 1), (30, 0), (40, 0), (45, 0), (90, 0)))
             .when(kind == 4, seen((0, 2), (20, 1), (90, 0))).otherwise(seen((0, 0), (10, 0), (20, 0), (90, 0))))
    every = listed.select("path", F.col("length").alias("_size"), "modified_time", F.explode(looks).alias("p")).select(
        "path", (F.col("_size") - F.col("p.less")).alias("length"), "modified_time",
        F.timestamp_millis(F.lit(int(POLL_START.timestamp() * 1000)) + F.col("p.at") * 100).alias("polled"))
    polls, out, checkpoint = (new_path(spark, name) for name in ("polls", "settled", "cp"))

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for early in (True, False):
        every.where((F.col("polled") < F.lit(POLL_START + timedelta(seconds=4))) == F.lit(early)).write.mode("append").parquet(polls)
        arrivals.on_arrival(arrivals.settled(arrivals.poll_stream(spark, polls), timeout="5 seconds"), handle, checkpoint).awaitTermination()
    found = spark.read.parquet(out)
    whole = arrivals.complete_only(found.where("outcome = 'complete'").select("path", "length", "outcome"))
    return whole.unionByName(found.where("outcome = 'timeout'").select("path", "length", "outcome")).select(
        doc_of_path().alias("doc_id"), "length", "outcome")


def notices(spark, sf):
    """A notice of a user's file for every event, and more of the same or another size 2 to 12 seconds later; every second file is a year old."""
    i, at = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    more = [F.struct(F.lit(s * 1_000_000).alias("after"), F.lit(d).alias("more")) for s, d in ((0, 0), (2, 0), (10, 0), (3, 1), (4, 0), (6, 0), (9, 0), (12, 0))]
    picked = F.when(i % 3 == 0, F.array(*more[:3])).when(i % 3 == 1, F.array(more[0], more[3], more[4])).otherwise(F.array(more[0], more[4], more[5], more[6], more[7]))
    each = I.table(spark, sf, "events").select("event_id", "user_id", "props", "ts", F.explode(picked).alias("n"))
    return each.select(
        F.concat(F.lit("/replays/"), F.col("user_id").cast("string"), F.lit(".dem")).alias("path"), (F.length("props") + F.col("n.more")).cast("long").alias("length"),
        F.timestamp_seconds(F.floor(at / 1_000_000) - i % 2 * 31536000).alias("modified_time"), F.timestamp_micros(at + F.col("n.after")).alias("arrived"))


def third(micros):
    """Ten days each: the three runs of the stream."""
    return F.least(F.floor((micros - F.lit(1704067200000000)) / 864000000000), F.lit(2))


@query("STR-3", """WITH RECURSIVE e AS (SELECT *, unnest(CASE event_id % 3 WHEN 0 THEN [(0, 0), (2, 0), (10, 0)] WHEN 1 THEN [(0, 0), (3, 1), (4, 0)]
      ELSE [(0, 0), (4, 0), (6, 0), (9, 0), (12, 0)] END::STRUCT(after BIGINT, more BIGINT)[]) AS n FROM events),
  n AS (SELECT '/replays/' || user_id || '.dem' AS path, length(props) + n.more AS length, floor(epoch_us(ts) / 1000000)::BIGINT - event_id % 2 * 31536000 AS modified_seconds,
    epoch_us(ts) + n.after * 1000000 AS us FROM e),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us, length, modified_seconds) AS i FROM n),
  r AS (SELECT path, i, length, modified_seconds, us, TRUE AS passed, length AS l, modified_seconds AS m, us AS a FROM o WHERE i = 1
    UNION ALL SELECT path, i, length, modified_seconds, us, passed, CASE WHEN passed THEN length ELSE l END, CASE WHEN passed THEN modified_seconds ELSE m END,
      CASE WHEN passed THEN us ELSE a END FROM (SELECT o.*, r.l, r.m, r.a, NOT (o.length = r.l AND o.modified_seconds = r.m AND o.us - r.a < 5000000) AS passed
        FROM r JOIN o ON o.path = r.path AND o.i = r.i + 1))
  SELECT path, length, modified_seconds, us AS arrived_micros FROM r WHERE passed""")
def str3(spark, sf):
    """Notices in three runs of one stream: the same again after 2 or 4 seconds is a repeat, after 6 or 10 it is news; so is another size at once."""
    src, out, checkpoint = (new_path(spark, name) for name in ("notices", "unique", "cp"))
    every = notices(spark, sf)

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for part in range(3):
        every.where(third(F.unix_micros("arrived")) == part).write.mode("append").parquet(src)
        stream = spark.readStream.schema("path string, length long, modified_time timestamp, arrived timestamp").parquet(src)
        arrivals.on_arrival(arrivals.without_repeats(stream), handle, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("path", "length", F.unix_seconds("modified_time").alias("modified_seconds"), F.unix_micros("arrived").alias("arrived_micros"))
