"""Readers and writers over real files, and streams over folders."""

import gzip
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickscope.operators import clean
from tickscope.plans import dataset
from tickscope.sources import files, sinks
from tickscope.sources import ticks as readers
from tickscope.streaming import arrivals


def put(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_parquet_ticks(spark, tmp_path):
    full = spark.createDataFrame([(1, " 76561198000000001 ", 1.0, 2.0, 3.0, 4.0, float("nan"), 9), (2, "a", 1.0, 2.0, 3.0, 4.0, 5.0, 9),
                                  (3, "a", 1.0, float("inf"), 3.0, 4.0, 5.0, 9)],
                                 "tick int, steamid string, X double, Y double, Z double, pitch double, yaw double, extra int")
    full.write.parquet(str(tmp_path / "cls" / "ok.parquet"))
    full.select("tick", "steamid").write.parquet(str(tmp_path / "cls" / "bad.parquet"))
    d = readers.read_ticks(spark, [str(tmp_path / "cls" / "ok.parquet"), str(tmp_path / "cls" / "bad.parquet")], match_column=False)
    d = d.withColumn("match_id", F.element_at(F.split("source_file", "/"), -2))
    assert "extra" not in d.columns and [r.tick for r in readers.clean_ticks(d).collect()] == [2]
    st = {r.match_id: r for r in readers.match_status(d).collect()}
    assert st["ok.parquet"].status == "accepted" and st["bad.parquet"].status == "rejected"
    assert st["bad.parquet"].missing == "X,Y,Z,pitch,yaw"
    with pytest.raises(RuntimeError):
        readers.require_coverage(readers.match_status(d))


def _typed(spark, path, select):
    base = spark.createDataFrame([(5, "76561198000000001", 1.0, 2.0, 3.0, 4.0, 5.0, 3, 90, True)],
                                 "tick long, steamid string, X double, Y double, Z double, pitch double, yaw double, team_num int, health int, spotted boolean")
    base.selectExpr(*select).coalesce(1).write.parquet(str(path))


@pytest.mark.parametrize("changed", [
    {"team_num": "cast(team_num as long)", "health": "cast(health as long)"}, {"health": "cast(health as double)"}, {"tick": "cast(tick as double)"},
    {"steamid": "cast(steamid as long)"}, {"spotted": "cast(spotted as int)"}, {"X": "cast(X as float)", "tick": "cast(tick as int)"}, {"X": "cast(X as string)"}])
def test_parquet_types(spark, tmp_path, changed):
    cols = ("tick", "steamid", "X", "Y", "Z", "pitch", "yaw", "team_num", "health", "spotted")
    _typed(spark, tmp_path / "in" / "odd", [f"{changed.get(c, c)} as {c}" for c in cols])
    _typed(spark, tmp_path / "in" / "plain", [*reversed(cols)])
    rows = readers.clean_ticks(readers.read_ticks(spark, str(tmp_path / "in"), match_column=False)).select(*cols).collect()
    assert [tuple(r) for r in rows] == [(5, "76561198000000001", 1.0, 2.0, 3.0, 4.0, 5.0, 3, 90, True)] * 2


def test_unreadable_file_is_a_rejected_match(spark, tmp_path):
    _typed(spark, tmp_path / "in" / "good", ["*"])
    put(str(tmp_path / "in" / "junk.parquet"), b"this is no table")
    st = {r.match_id: r.status for r in readers.match_status(readers.read_ticks(spark, str(tmp_path / "in"), match_column=False)).collect()}
    assert st["in_junk"] == "rejected" and list(st.values()).count("accepted") == 1


def test_csv_columns_by_name(spark, tmp_path):
    put(str(tmp_path / "c" / "one.csv"), b"tick,steamid,X,Y,Z,pitch,yaw,health\n7,76561198000000001,1,2,3,4,5,100\n")
    put(str(tmp_path / "c" / "two.csv.gz"), gzip.compress(b"yaw,steamid,tick,pitch,Z,Y,X\n5,76561198000000002,8.0,4,3,2,1\n"))
    put(str(tmp_path / "c" / "none.csv.gz"), b"no gzip")
    d = readers.read_ticks_csv(spark, str(tmp_path / "c"), match_column=False)
    got = {(r.match_id, r.tick, r.steamid, r.X, r.yaw, r.health) for r in readers.clean_ticks(d).collect()}
    assert got == {("c_one", 7, "76561198000000001", 1.0, 5.0, 100), ("c_two", 8, "76561198000000002", 1.0, 5.0, None)}
    assert {r.match_id: r.status for r in readers.match_status(d).collect()}["c_none"] == "rejected"


HEADER = b"tick,steamid,X,Y,Z,pitch,yaw,remark\n"


@pytest.mark.parametrize("packed", [False, True])
def test_letters_at_any_byte(spark, tmp_path, packed):
    """Wherever a block of bytes ends, also inside a letter: in the header, behind it, and in a header longer than a block."""
    names = []
    for shift in range(4):
        rows = "".join(f"{i},76561198000000001,1,2,3,4,5,{'x' * shift}{'жä日𝄞' * 40}\n" for i in range(500)).encode()
        wide = b"tick,steamid,X,Y,Z,pitch,yaw," + b"x" * shift + "ж日𝄞".encode() * 9000 + b"\n"
        for kind, head in (("short", HEADER), ("wide", wide), ("odd", HEADER.replace(b"remark", b"rem\xff\xe6ark")), ("bom", b"\xef\xbb\xbf" + HEADER)):
            names.append(f"{kind}{shift}")
            data = head + rows
            put(str(tmp_path / "c" / (names[-1] + (".csv.gz" if packed else ".csv"))), gzip.compress(data) if packed else data)
    d = readers.read_ticks_csv(spark, str(tmp_path / "c"), match_column=False)
    assert {(r.match_id, r.status, r.rows) for r in readers.match_status(d).collect()} == {(f"c_{n}", "accepted", 500) for n in names}


def test_no_header(spark, tmp_path):
    put(str(tmp_path / "c" / "blank.csv"), b"\n1,2\n")
    put(str(tmp_path / "c" / "cut.csv.gz"), gzip.compress(HEADER * 1000)[:15])
    put(str(tmp_path / "c" / "parts.csv.gz"), gzip.compress(HEADER[:9]) + gzip.compress(HEADER[9:] + b"1,a,1,2,3,4,5,x\n"))
    got = {r.path.rsplit("/", 1)[1]: r.header for r in readers.file_headers(files.list_files(spark, str(tmp_path / "c"))).collect()}
    assert got == {"blank.csv": None, "cut.csv.gz": None, "parts.csv.gz": HEADER.decode().strip()}


def test_storage_errors_are_not_a_format(spark, tmp_path):
    """A file that cannot be opened fails the read; it is not a match without columns."""
    gone = spark.createDataFrame([(f"file:{tmp_path}/gone.csv",)], "path string")
    for probe in (readers.file_headers, readers.file_schemas):
        with pytest.raises(Exception, match="gone.csv|No such file"):
            probe(gone).collect()


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    """One plain file in many pieces, every row three times far apart: the first line wins."""
    rows = [(i % 4000, i // 4000) for i in range(12000)]
    text = "".join(f"{tick},76561198000000001,{turn},2,3,4,5,{'ж' * (tick % 90)}\n" for tick, turn in rows)
    put(str(tmp_path / "c" / "long.csv"), HEADER + text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        d = readers.read_ticks_csv(spark, str(tmp_path / "c"), match_column=False)
        assert d.select("source_block").distinct().count() > 20
        first = clean.deduplicate_ticks(readers.clean_ticks(d), readers.SOURCE).collect()
        lines = [(r.tick, r.X) for r in d.orderBy(*readers.SOURCE).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(first) == 4000 and {r.X for r in first} == {0.0} and lines == [(t, float(n)) for t, n in rows]


def test_foreign_columns_need_no_scan_of_their_own(spark, tmp_path):
    """Files that differ only in columns nobody reads are one scan, which reads the contract's columns."""
    base = spark.createDataFrame([(5, "76561198000000001", 1.0, 2.0, 3.0, 4.0, 5.0)], "tick long, steamid string, X double, Y double, Z double, pitch double, yaw double")
    for i in range(6):
        base.withColumn(f"foreign{i}", F.lit(i)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    d = readers.read_ticks(spark, [str(tmp_path / "in" / f"p{i}") for i in range(6)], match_column=False)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "foreign0" not in plan and readers.clean_ticks(d).count() == 6


def test_path_schemes():
    from tickscope.sources.paths import normalize

    assert normalize("file:/a/b") == "file:///a/b" and normalize("s3a://k/x") == "s3://k/x" and normalize("dbfs:/x/y") == "/dbfs/x/y"
    assert normalize("/a:b/c") == "/a:b/c" and normalize("hdfs://n:1/x") == "hdfs://n:1/x"


def run_twice(spark, tmp_path, stream_of, schema, runs):
    """Rows of each run are written, then the stream goes on from its checkpoint; what came out, in the order of runs."""
    src, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    got = []
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        arrivals.on_arrival(stream_of(src), lambda b, n, i=i: b.write.mode("overwrite").parquet(f"{out}/run={i}/batch={n}"), cp).awaitTermination()
        got.append(spark.read.parquet(f"{out}/run={i}") if os.path.isdir(f"{out}/run={i}") else None)
    return got


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


def test_settled_files(spark, tmp_path):
    """Complete after two polls that changed nothing; growth begins the count anew; state lasts over runs; a changed file is followed again."""
    def polls(*looks):
        return [(p, n, at(0), at(s)) for p, s, n in looks]

    runs = [polls(("a", 0, 9), ("a", 1, 9), ("a", 2, 9), ("a", 3, 9), ("b", 0, 9), ("b", 1, 10), ("b", 2, 10), ("short", 0, 7), ("short", 1, 7), ("short", 2, 7)),
            polls(("a", 4, 9), ("b", 3, 10), ("b", 4, 10), ("short", 30, 7), ("grows", 4, 8), ("grows", 5, 9), ("grows", 9.5, 10), ("a", 30, 9), ("b", 30, 10)),
            polls(("a", 31, 20), ("a", 32, 20), ("a", 33, 20), ("b", 33, 10))]
    got = run_twice(spark, tmp_path, lambda src: arrivals.settled(arrivals.poll_stream(spark, src), timeout="5 seconds"), arrivals.POLL_SCHEMA, runs)
    rows = [sorted((r.path, r.length, r.outcome, (r.polled - at(0)).total_seconds()) for r in g.collect()) if g else [] for g in got]
    assert rows[0] == [("a", 9, "complete", 2.0)]
    assert rows[1] == [("b", 10, "complete", 3.0), ("grows", 9, "timeout", 9.0), ("grows", 10, "timeout", 14.5), ("short", 7, "timeout", 5.0)]
    assert rows[2] == [("a", 20, "complete", 33.0)]


def test_repeats_by_time(spark, tmp_path):
    """The same notice 2 s after one that passed is a repeat, 10 s after it is news; the clock starts at what passed, not at what was held back."""
    def notices(*seen):
        return [(p, n, at(0), at(s)) for p, s, n in seen]

    runs = [notices(("p", 0, 1), ("p", 2, 1), ("p", 4.9, 1), ("p", 5, 1), ("q", 1, 1), ("q", 2, 2), ("q", 3, 1)), notices(("p", 7, 1), ("q", 10, 1), ("p", 15, 1)),
            notices(("p", 300, 1), ("p", 301, 1))]
    schema = "path string, length long, modified_time timestamp, arrived timestamp"
    got = run_twice(spark, tmp_path, lambda src: arrivals.without_repeats(spark.readStream.schema(schema).parquet(src)), schema, runs)
    rows = [sorted((r.path, (r.arrived - at(0)).total_seconds(), r.length) for r in g.collect()) for g in got]
    assert rows == [[("p", 0.0, 1), ("p", 5.0, 1), ("q", 1.0, 1), ("q", 2.0, 2), ("q", 3.0, 1)], [("p", 15.0, 1), ("q", 10.0, 1)], [("p", 300.0, 1)]]


def test_odd_paths_are_found_again(spark, tmp_path):
    """Files of a match by the index, also where a folder's name needs escapes."""
    src, index = str(tmp_path / "a b+c%20é"), str(tmp_path / "index")
    _typed(spark, tmp_path / "a b+c%20é" / "x", ["*", "'m' as match_id"])
    for batch in (0, 1, 1):  # a repeated batch writes its own place
        arrivals.index_files(readers.read_ticks(spark, src), index, batch)
    found = arrivals.files_of(spark, index, spark.createDataFrame([("m",)], "match_id string"))
    assert len(found) == 1 and readers.read_ticks(spark, found).count() == 1


def test_old_notices_are_not_lost(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for path, s in (("new", 2_000_000_000), ("newer", 2_000_000_100), ("year old", 1_960_000_000), ("new", 2_000_000_000)):
        spark.createDataFrame([(path, 10, s)], "path string, length long, s long").select(
            "path", "length", F.timestamp_seconds("s").alias("modified_time")).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("path string, length long, modified_time timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    arrivals.on_arrival(arrivals.without_repeats(s, "1 hour"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["new", "newer", "year old"]


def test_csv_ticks(spark, tmp_path):
    text = "tick,steamid,X,Y,Z,pitch,yaw,health,junk\n1,a,1,2,3,4,5,100,z\nbad,a,1,2,3,4,5,100,z\n2,a,1,2,3,4,n/a,0,z\n"
    put(str(tmp_path / "cls" / "game.csv.gz"), gzip.compress(text.encode()))
    d = readers.read_ticks_csv(spark, str(tmp_path / "cls"), match_column=False)
    rows = readers.clean_ticks(d).collect()
    assert [(r.match_id, r.tick, r.health, r.name) for r in rows] == [("cls_game", 1, 100, "a")]


def test_events_json(spark, tmp_path):
    doc = {"CSstats_info": [{"map": "de_x", "server": "s"}], "cheaters": [{"steamid": " c1 "}, {"steamid": "c1"}],
           "weapon_fire": [{"tick": 5, "user_steamid": "a", "weapon": "ak"}],
           "player_hurt": [{"tick": 6, "attacker_steamid": "a", "user_steamid": "b", "dmg_health": 3}],
           "player_death": [{"tick": 7, "attacker_steamid": "a", "user_steamid": "b", "headshot": True}]}
    put(str(tmp_path / "c" / "one.json"), json.dumps(doc, indent=1).encode())
    put(str(tmp_path / "c" / "two.json"), json.dumps({"cheaters": ["c2", ""]}).encode())
    put(str(tmp_path / "c" / "bad.json"), b'{"cheaters": [')
    docs = readers.read_event_documents(spark, str(tmp_path / "c"))
    assert {(r.match_id, r.steamid) for r in readers.cheater_ids(docs).collect()} == {("c_one", "c1"), ("c_two", "c2")}
    assert [r.match_id for r in readers.corrupt_documents(docs).collect()] == ["c_bad"]
    got = {(k, r.tick, r.actor, r.victim) for k in readers.EVENT_KINDS for r in readers.explode_events(docs, k).collect()}
    assert got == {("weapon_fire", 5, "a", None), ("player_hurt", 6, "a", "b"), ("player_death", 7, "a", "b")}
    assert [(r.map_name, r.server_name) for r in readers.match_header(docs).collect()] == [("de_x", "s")]
    with pytest.raises(ValueError):
        readers.explode_events(docs, "bomb")


def test_dedupe_and_ids(spark):
    d = spark.createDataFrame([("m", "a", t, i) for i, t in enumerate([102, 100, 101, 101])], "match_id string, steamid string, tick long, i int")
    assert sorted((r.tick, r.i) for r in clean.deduplicate_ticks(d, ("i",)).collect()) == [(100, 1), (101, 2), (102, 0)]
    ids = spark.createDataFrame([(" 76561198000000001.0",), ("nan",), ("0",), ("",), ("1234",)], "steamid string")
    assert [r.steamid for r in clean.clean_ids(ids).collect()] == ["76561198000000001"]


MAGIC = bytes.fromhex(files.MAGIC_HEX)


@pytest.fixture
def replays(tmp_path):
    tmp_path = tmp_path / "replays"
    put(str(tmp_path / "a_De_Dust.dem"), MAGIC + b"\0" * 20)
    put(str(tmp_path / "b.dem"), b"PBDEMS1\0" + b"\0" * 20)
    put(str(tmp_path / "b.dem.info"), b"\xff\xfe junk cs_office junk")
    put(str(tmp_path / "c.dem"), b"PB")
    os.utime(tmp_path / "b.dem", (2_000_000_000, 2_000_000_000))
    return str(tmp_path)


def test_catalog_and_header(spark, replays):
    dem = files.list_files(spark, replays, "*.dem")
    info = files.with_head(files.list_files(spark, replays, "*.info"), files.INFO_BYTES)
    rows = [(r.file_name, r.map_name) for r in files.replay_catalog(dem, info).collect()]
    assert rows[0] == ("b.dem", "cs_office") and set(rows) == {("b.dem", "cs_office"), ("a_De_Dust.dem", "de_dust"), ("c.dem", None)}
    ok = files.valid_header(files.with_head(dem, 8)).collect()
    assert [os.path.basename(r.path) for r in ok] == ["a_De_Dust.dem"]


def test_pairs(spark, tmp_path):
    for p in ("with_cheater_present/1.parquet", "with_cheater_present/1.csv.gz", "with_cheater_present/1.json", "no_cheater_present/1.csv.gz",
              "no_cheater_present/2.json", "no_cheater_present/3.csv.gz", "no_cheater_present/3.json", "no_cheater_present/notes.txt"):
        put(str(tmp_path / p), b"x")
    pairs = files.discover_pairs(files.list_files(spark, str(tmp_path), recursive=True))
    got = {(r.match_category, r.base): (r.status, os.path.basename(r.data_path or "")) for r in pairs.collect()}
    assert got == {(dataset.WITH, "1"): ("paired", "1.parquet"), (dataset.WITHOUT, "1"): ("missing_json", "1.csv.gz"),
                   (dataset.WITHOUT, "2"): ("orphan_json", ""), (dataset.WITHOUT, "3"): ("paired", "3.csv.gz")}


def test_manifest_round_trip(spark, tmp_path):
    row = ("m", "c", "d", "j", "c", "high", "s", " a, ,nan,b", 2, True, "train")
    sinks.write_manifest(spark.createDataFrame([row], sinks.MANIFEST_SCHEMA), str(tmp_path / "m"))
    r = sinks.read_manifest(spark, str(tmp_path / "m")).first()
    assert r.cheaters == ["a", "b"] and r.usable_for_training is True


def test_feature_metadata_is_checked(spark, tmp_path):
    sinks.write_features(spark.range(3), str(tmp_path / "f"), {"schema_hash": "x"})
    assert sinks.read_features(spark, str(tmp_path / "f"), {"schema_hash": "x"}).count() == 3
    with pytest.raises(ValueError):
        sinks.read_features(spark, str(tmp_path / "f"), {"schema_hash": "y"})


def test_features_are_reused_for_the_same_manifest_and_schema(spark, tmp_path):
    path, built = str(tmp_path / "f"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    meta = {"schema_hash": "x", "manifest": sinks.manifest_hash(spark.createDataFrame([("m", "a")], "match_id string, label string"))}
    assert [sinks.features_for(spark, path, meta, lambda: build(3))[1] for _ in range(2)] == [False, True]
    other = meta | {"manifest": sinks.manifest_hash(spark.createDataFrame([("m", "b")], "match_id string, label string"))}
    got = [sinks.features_for(spark, path, other, lambda: build(4)) for _ in range(2)]
    assert [(d.count(), reused) for d, reused in got] == [(4, False), (4, True)] and built == [3, 4]
    assert sinks.read_features(spark, path, meta).count() == 3


def test_results_are_paged(spark, tmp_path):
    m = spark.createDataFrame([("m", "none")], "match_id string, global_verdict string")
    p = spark.createDataFrame([("m", "a", "CLEAN"), ("m", "b", "CLEAN")], "match_id string, steamid string, verdict string")
    e = spark.createDataFrame([("m", "a", "aim_snap", i) for i in range(1, 26)], "match_id string, steamid string, type string, seq long")
    sinks.write_results(m, p, e, str(tmp_path / "r"), page=10)
    m2, p2, e2 = sinks.read_results(spark, str(tmp_path / "r"), m, p, e)
    assert m2.collect() == m.collect() and sorted(p2.collect()) == sorted(p.collect())
    assert sorted(e2.select(*e.columns).collect()) == sorted(e.collect())


def test_stream_of_replays(spark, replays, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        def handle(batch, i):
            arrivals.complete_only(batch).write.mode("overwrite").parquet(f"{out}/batch={i}")

        arrivals.on_arrival(arrivals.replay_arrivals(spark, replays), handle, cp).awaitTermination()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())

    assert run() == ["a_De_Dust.dem"]
    put(os.path.join(replays, "new.dem"), MAGIC + b"\0")
    assert run() == ["a_De_Dust.dem", "new.dem"]  # only the new file is read again


def test_stream_repeats(spark, tmp_path):
    rows = [("p1", 10, 100), ("p1", 10, 100), ("p1", 11, 100), ("p2", 10, 130)]
    spark.createDataFrame(rows, "path string, length long, s long").select("path", "length", F.timestamp_seconds("s").alias("modified_time")
                                                                         ).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("path string, length long, modified_time timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    arrivals.on_arrival(arrivals.without_repeats(s), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.path, r.length) for r in spark.read.parquet(out).collect()) == [("p1", 10), ("p1", 11), ("p2", 10)]


def test_retention_deletes(spark, tmp_path):
    """The least recently used keys go: from readers at once, from disk with the purge; used or put again they live."""
    from tickscope.sources import result_store as store
    path = str(tmp_path / "store")

    def rows(*keys):
        return spark.createDataFrame([(k, at(s), i) for k, s in keys for i in range(2)], "result_key string, last_used timestamp, n int")

    def alive():
        return sorted(r.result_key for r in store.read(spark, path).select("result_key").distinct().collect())

    def on_disk():
        return sorted(r.result_key for r in store.stored_folders(spark, path).collect())

    keys = ["007", "a b", "x/y=z", "é+%20", "last"]
    store.put(rows(*[(k, i) for i, k in enumerate(keys)]), path)
    assert alive() == on_disk() == sorted(keys) and store.purge(spark, path) == 0
    store.touch(rows(("007", 90)), path)
    before = store.read(spark, path)
    store.evict(spark, path, 3)
    assert alive() == sorted(["007", "é+%20", "last"]) and on_disk() == sorted(keys) and before.count() == 10  # who listed before reads on
    assert store.purge(spark, path) == 2 and on_disk() == alive() and store.purge(spark, path) == 0
    store.put(rows(("a b", 95)), path)  # comes back
    store.put(rows(("last", 96)).limit(1), path)  # replaced, not doubled
    assert alive() == sorted(["007", "a b", "é+%20", "last"]) and store.read(spark, path).count() == 7
    store.evict(spark, path, 1)
    assert store.purge(spark, path) == 3 and alive() == on_disk() == ["last"]


def test_heads_source(spark, replays, tmp_path):
    """Only what the filters leave is opened, and no more than the bytes asked for; the same files as Spark's own listing."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains, StringEndsWith

    from tickscope.sources import heads
    put(replays + "/_hidden/x.dem", b"x")
    put(replays + "/sub dir/d%20é.dem", MAGIC + b"long" * 1000)
    d = heads.file_heads(spark, replays, "*.dem", 8)
    own = {(r.path, r.length, r.modified_time) for r in files.list_files(spark, replays, "*.dem", recursive=True).collect()}
    assert {(r.path, r.length, r.modified_time) for r in d.collect()} == own and len(own) == 4
    ok = files.valid_header(d.where("length >= 8")).collect()
    assert sorted(os.path.basename(r.path) for r in ok) == ["a_De_Dust.dem", "d%20é.dem"] and all(len(r.head) == 8 for r in ok)
    assert heads.file_heads(spark, replays, "*.info,*.dem").where("head is null").count() == 5
    assert d.where(F.col("path").contains("sub dir") & (F.col("length") > 5) & F.col("modified_time").isNotNull()).count() == 1
    reader = heads.HeadReader({"path": replays, "glob": "*.dem", "bytes": "8", "files_per_task": "1"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("length",), 8), StringEndsWith(("path",), ".dem"), StringContains(("path",), "/b"), EqualTo(("head",), b"")]))
    assert left == [EqualTo(("head",), b"")] and [[os.path.basename(f[0]) for f in c.files] for c in reader.partitions()] == [["b.dem"]]


def test_texts_are_files_of_their_own(spark, tmp_path):
    """One file a row, whole and under its own name, written again in place; folders are read back as partitions, whatever the values."""
    from tickscope.sources import sinks
    rows = [("m1", "a/b=c", "x"), ("m1", "é %20", "y\nz"), ("m2", None, None)]
    df = spark.createDataFrame(rows, "m string, who string, value string").withColumn("path", F.lit("t.txt"))
    for _ in range(2):
        sinks.write_texts(df, str(tmp_path / "t"), ("m", "who"))
    got = spark.read.text(str(tmp_path / "t"), wholetext=True).collect()
    assert sorted((r.m, r.who or "", r.value) for r in got) == [("m1", "a/b=c", "x\n"), ("m1", "é %20", "y\nz\n"), ("m2", "", "\n")]
    assert sorted(f.name for f in (tmp_path / "t").rglob("*") if f.is_file()) == ["t.txt"] * 3


def test_store_writes_one_file_a_key(spark, tmp_path):
    """No file beside it, nothing of an older layout left; a key's rows are one file across batches, and null is a key too."""
    from tickscope.sources import result_store as store
    rows = spark.range(30000).selectExpr("if(id < 3, null, if(id < 25000, 'big', concat('k', id % 3))) result_key", "timestamp_seconds(id) last_used", "id n")
    path = tmp_path / "store"
    (path / "data" / "result_key=big").mkdir(parents=True)
    rows.limit(5).drop("result_key").coalesce(1).write.mode("append").parquet(str(path / "data" / "result_key=big"))
    store.put(rows, str(path))
    assert sorted(f.name for f in (path / "data").rglob("*.parquet") if f.name[0] != ".") == ["rows.parquet"] * 5
    got = {r.result_key: (r.n, r.s) for r in store.data(spark, str(path)).groupBy("result_key").agg(F.count("*").alias("n"), F.sum("n").alias("s")).collect()}
    assert got == {r.result_key: (r.n, r.s) for r in rows.groupBy("result_key").agg(F.count("*").alias("n"), F.sum("n").alias("s")).collect()} and len(got) == 5


def test_polls_of_a_file_are_ordered_as_tuples():
    """By time, then length, then time of change, across the frames of a group."""
    import pandas as pd
    t = pd.to_datetime([20, 10, 10], unit="us")
    a = pd.DataFrame({"polled": t, "length": [1, 5, 5], "modified_time": pd.to_datetime([7, 9, 8], unit="us")})
    rows, ordered = arrivals._in_order(iter([a, a.head(1)]), "polled")
    assert ordered == [(10, 5, 8, 2), (10, 5, 9, 1), (20, 1, 7, 0), (20, 1, 7, 3)] and len(rows) == 4


def test_tree_is_listed_by_tasks(spark, replays, tmp_path):
    """The same files as Spark's own listing, whatever their depth and names, and no scan that has them one by one."""
    put(replays + "/_hidden/x.dem", b"x")
    put(replays + "/_day=1/.part/x.dem", b"x")
    put(replays + "/_day=1/b+c%20é/y.dem", b"y")
    put(replays + "/_day=1/y.dem._COPYING_", b"y")
    put(replays + "/empty.dem", b"")
    for i in range(300):
        put(f"{replays}/many/{i % 3}/{i}.dem", b"long" * (i % 5 + 1))

    def rows(df):
        return sorted((r.path, r.modified_time, r.length) for r in df.collect())

    tree = files.list_tree(spark, replays, "*.dem")
    assert rows(tree) == rows(files.list_files(spark, replays, "*.dem", recursive=True)) and tree.columns == ["path", "modified_time", "length"]
    assert not any(f.endswith(".dem") for f in tree.inputFiles()) and tree.where("path like '%/many/%'").count() == 300
    assert rows(files.list_tree(spark, "file://" + replays, "*.info,*.dem")) == rows(files.list_files(spark, replays, "{*.info,*.dem}", recursive=True))
    (tmp_path / "none").mkdir()
    assert files.list_tree(spark, str(tmp_path / "none")).count() == 0


def test_files_share_rows_of_state(spark, tmp_path):
    """Few groups follow many files, yet each file has its own count and timer, also in a batch that only brings polls of others."""
    def polls(names, *looks):
        return [(f"{n}", length, at(0), at(s)) for n in names for s, length in looks]

    src, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    seen = []
    for rows in (polls(range(300), (0, 9), (1, 9)), polls(range(100), (2, 9)) + polls(range(100, 200), (3, 10)), polls(["new"], (60, 9)), polls(["new"], (61, 9), (62, 9)), polls(["last"], (4000, 9))):
        spark.createDataFrame(rows, arrivals.POLL_SCHEMA).write.mode("append").parquet(src)
        stream = arrivals.settled(arrivals.poll_stream(spark, src), timeout="5 seconds", buckets=8)
        run = arrivals.on_arrival(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), cp)
        run.awaitTermination()
        seen.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r.path, r.length, r.outcome, (r.polled - at(0)).total_seconds()) for r in spark.read.parquet(out).collect()}
    assert got == ({(f"{i}", 9, "complete", 2.0) for i in range(100)} | {(f"{i}", 10, "timeout", 5.0) for i in range(100, 200)}
                   | {(f"{i}", 9, "timeout", 5.0) for i in range(200, 300)} | {("new", 9, "complete", 62.0)})
    assert max(seen) <= 8 and seen[-1] == 1  # all others are forgotten
