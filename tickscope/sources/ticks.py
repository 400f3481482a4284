"""Tick and event readers."""

import csv
import gzip
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.operators.clean import CRITICAL, drop_non_finite, nan_to_null, normalize_events
from tickscope.sources.files import list_files
from tickscope.sources.paths import open_file

TICK_TYPES = {
    "tick": "long", "steamid": "string", "X": "double", "Y": "double", "Z": "double", "pitch": "double", "yaw": "double",
    "name": "string", "team_num": "int", "health": "int", "spotted": "boolean", "is_airborne": "boolean",
    "velocity_X": "double", "velocity_Y": "double", "velocity_Z": "double", "active_weapon_name": "string",
    "shots_fired": "int", "is_firing": "boolean",
}
EVENTS_SCHEMA = """
  match_id string,
  CSstats_info array<struct<map:string,server:string>>,
  cheaters string,
  weapon_fire array<struct<tick:long,user_steamid:string,user_name:string,weapon:string,silenced:boolean>>,
  player_hurt array<struct<tick:long,attacker_steamid:string,user_steamid:string,dmg_health:int>>,
  player_death array<struct<tick:long,attacker_steamid:string,user_steamid:string,headshot:boolean>>,
  _corrupt string
"""
#: Where a row stands in its source: file, first byte of the piece that a task read, row in the order of reading. Inside a file this is the order of lines.
SOURCE = ("source_file", "source_block", "source_row")
#: Longest first line of a CSV file that can be a header.
HEADER_LIMIT = 16 << 20
EVENT_KINDS = ("weapon_fire", "player_hurt", "player_death")


def match_of_path(path: Column) -> Column:
    """class directory + base name of the file."""
    parts = F.split(path, "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"\.(parquet|csv\.gz|csv|json)$", "")
    return F.concat_ws("_", F.element_at(parts, -2), base)


def _contract(df: DataFrame) -> list:
    """Every tick column in its contract type, null where ``df`` has none. Text and odd numbers never fail the job."""
    have, out = dict(df.dtypes), []
    for c, t in TICK_TYPES.items():
        x = F.col(c) if c in have else F.lit(None).cast("string")
        if t == "string" and have.get(c) in ("double", "float") or have.get(c, "").startswith("decimal"):
            x = x.try_cast("bigint")  # an id stored as a number; never printed as 7.6E16
        if t in ("long", "int") and have.get(c) == "string":
            x = x.try_cast("double")  # "12.0" is a whole number
        if t in ("long", "int") and have.get(c) in ("double", "float", "string"):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
        out.append(x.try_cast(t).alias(c))
    return out


def _footer(f) -> bytes | None:
    """The end of a Parquet file: its metadata with the marks around it. None if the marks are not there."""
    size = f.size()
    if size < 12:
        return None
    f.seek(size - 8)
    end = f.read(8)
    length = int.from_bytes(end[:4], "little")
    if end[4:] != b"PAR1" or length + 12 > size:
        return None
    f.seek(size - 8 - length)
    return b"PAR1" + f.read(length) + end


def file_schemas(files: DataFrame) -> DataFrame:
    """(path, columns) of Parquet files: names and types of the contract's columns as one text, from the footers, read by the tasks; null if there
    is none. Other columns do not matter, since nobody reads them.

    Only what is no footer makes a file unreadable. A storage error fails the task, and Spark tries it again.
    """
    wanted = {"match_id", *TICK_TYPES}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            found = []
            for p in b["path"]:
                with open_file(p) as f:
                    footer = _footer(f)
                try:
                    schema = pq.read_schema(pa.BufferReader(footer)) if footer else None
                except (OSError, ValueError):  # of bytes in memory: no Parquet metadata
                    schema = None
                found.append(None if schema is None else ";".join(sorted(f"{c.name}:{c.type}" for c in schema if c.name in wanted)))
            yield pd.DataFrame({"path": b["path"], "columns": found})

    return files.select("path").mapInPandas(read, "path string, columns string")


def _grouped(files: DataFrame, kind: str) -> list:
    """(kind, paths): files that can be read by one scan. Few kinds, and paths that any scan lists on the driver too."""
    return files.groupBy(kind).agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(kind).collect()


def _listed(spark: SparkSession, paths: str | Sequence[str], glob: str) -> DataFrame:
    return list_files(spark, paths, glob, recursive=True).select("path")


def _unreadable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One empty row per file that cannot be read, so that ``match_status`` rejects it under its own name."""
    rows = spark.createDataFrame([(p,) for p in paths], "source_file string")
    empty = rows.select(match_of_path(F.col("source_file")).alias("match_id"), "source_file", *[F.lit(0).cast("long").alias(c) for c in SOURCE[1:]])
    return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in TICK_TYPES.items()])


def _one_scan(df: DataFrame, match_column: bool) -> DataFrame:
    """Contract columns of one scan. Columns the contract does not name are not read."""
    named = F.col("match_id").cast("string") if match_column and "match_id" in df.columns else match_of_path(F.col("_metadata.file_path"))
    return df.select(named.alias("match_id"), F.col("_metadata.file_path").alias("source_file"), F.lit(0).cast("long").alias("source_block"),
                     F.col("_metadata.row_index").alias("source_row"), *_contract(df))


def read_ticks(spark: SparkSession, paths: str | Sequence[str], match_column: bool = True) -> DataFrame:
    """Parquet ticks with their place in the file (``SOURCE``).

    Files are grouped by the types of the contract's columns, one scan per distinct set, and each is cast to the contract. An absent
    column is null; a file that is no Parquet file is one row without values, hence a rejected match (Spark does not list files of no bytes). Without a match_id
    column the file is the match.
    """
    parts, bad = [], []
    for kind, found in _grouped(file_schemas(_listed(spark, paths, "*.parquet")), "columns"):
        if kind is None:
            bad += found
        else:
            parts.append(_one_scan(spark.read.parquet(*found), match_column))
    if bad or not parts:
        parts.append(_unreadable(spark, bad))
    return tidy_ticks(reduce(DataFrame.unionByName, parts))


def _first_line(f, packed: bool) -> bytes | None:
    """Bytes before the first line break, however long the line is. None if this is no gzip file or the line is too long to be a header."""
    if packed:
        try:
            line = gzip.GzipFile(fileobj=f).readline(HEADER_LIMIT + 1)
        except (gzip.BadGzipFile, EOFError, zlib.error):
            return None
    else:
        line = b""
        while b"\n" not in line and len(line) <= HEADER_LIMIT:
            block = f.read(65536)
            if not block:
                break
            line += block
        line = line.split(b"\n", 1)[0]
    return line if len(line) <= HEADER_LIMIT else None


def file_headers(files: DataFrame) -> DataFrame:
    """(path, header) of CSV and CSV.GZ files: the first line, null if there is none.

    Bytes are cut at the line break and only then read as letters; bytes that are none are left out, so neither what follows the header nor an
    odd byte in it loses the file. A storage error fails the task, and Spark tries it again.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for p in b["path"]:
                with open_file(p) as f:
                    line = _first_line(f, p.endswith(".gz"))
                found.append((line or b"").decode("utf-8-sig", errors="ignore").strip("\r\n") or None)
            yield pd.DataFrame({"path": b["path"], "header": found})

    return files.select("path").mapInPandas(read, "path string, header string")


def read_ticks_csv(spark: SparkSession, paths: str | Sequence[str], match_column: bool = True,
                   tick_block: int = 65536) -> DataFrame:
    """CSV / CSV.GZ with a header. Files are grouped by their header line, so columns are found by name in any order.

    A gzip file is read by one task, so rows are spread again by match and tick block. A large plain file is read in pieces, in any order and by
    any task; ``SOURCE`` orders its rows by the piece's first byte and the place in the piece, which is the order of lines.
    """
    parts, bad = [], []
    listed = _listed(spark, paths, "*.{csv,csv.gz}")
    for header, found in _grouped(file_headers(listed), "header"):
        if header is None:
            bad += found
            continue
        columns = [c.strip() for c in next(csv.reader([header]))]
        schema = T.StructType([T.StructField(c if c and c not in columns[:i] else f"_{i}", T.StringType()) for i, c in enumerate(columns)])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(found)
        named = F.col("match_id") if match_column and "match_id" in columns else match_of_path(F.col("_metadata.file_path"))
        parts.append(raw.select(named.alias("match_id"), F.col("_metadata.file_path").alias("source_file"),
                                F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("source_row"),
                                *_contract(raw)))
    if bad or not parts:
        parts.append(_unreadable(spark, bad))
    df = reduce(DataFrame.unionByName, parts)
    return tidy_ticks(df.repartition(F.col("match_id"), F.floor(F.col("tick") / tick_block)))


def tidy_ticks(df: DataFrame) -> DataFrame:
    """Trimmed text ids, name = id where absent, no NaN."""
    sid = F.trim(F.col("steamid").cast("string"))
    return nan_to_null(df.withColumn("steamid", sid).withColumn("name", F.coalesce("name", sid)))


def clean_ticks(df: DataFrame) -> DataFrame:
    """Rows usable by the detectors. A match that lacks a critical column loses all rows here, so rejecting it
    needs no join; ``match_status`` says why."""
    return drop_non_finite(df).where("steamid is not null")


def match_status(df: DataFrame) -> DataFrame:
    """One row per match: accepted, or rejected with the critical columns that hold no value."""
    n = df.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in CRITICAL])
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in CRITICAL]),
                                    lambda x: x.isNotNull()), ",")
    return n.select("match_id", "rows", missing.alias("missing"),
                    F.when(missing == "", "accepted").otherwise("rejected").alias("status"))


def extraction_gate(status: DataFrame, limit: float = 0.30) -> DataFrame:
    """Share of matches that failed, as one row."""
    failed = F.count_if(F.col("status") != "accepted")
    rate = F.coalesce(F.try_divide(failed, F.count(F.lit(1))), F.lit(1.0))
    return status.agg(F.count(F.lit(1)).alias("matches"), failed.alias("failed"), rate.alias("failure_rate"),
                      (rate > limit).alias("too_many"))


def require_coverage(status: DataFrame, limit: float = 0.30) -> None:
    row = extraction_gate(status, limit).first()
    if row["too_many"]:
        raise RuntimeError(f"{row['failed']} of {row['matches']} matches failed, more than {limit:.0%}")


def read_event_documents(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True,
                         match_column: bool = False) -> DataFrame:
    """JSON documents: one per file (``multiline``) or one per line, of which a match may have several."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(EVENTS_SCHEMA).option("multiLine", multiline).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(paths)
    return df if match_column else df.withColumn("match_id", match_of_path(F.col("_metadata.file_path")))


def explode_events(docs: DataFrame, kind: str) -> DataFrame:
    if kind not in EVENT_KINDS:
        raise ValueError(f"unknown event kind {kind}")
    return normalize_events(docs.select("match_id", F.inline(kind)), kind)


def corrupt_documents(docs: DataFrame) -> DataFrame:
    """Matches with an unreadable document. The length test keeps a data column in the scan, which Spark demands."""
    return docs.where(F.col("_corrupt").isNotNull() & (F.coalesce(F.length("cheaters"), F.lit(0)) >= 0)).select(
        "match_id").distinct()


def cheater_ids(docs: DataFrame) -> DataFrame:
    """(match, steamid) from a list of objects with a steamid or of plain texts."""
    one = F.from_json("cheaters", "array<string>")
    sid = F.transform(one, lambda e: F.trim(F.coalesce(F.get_json_object(e, "$.steamid"), e)))
    return docs.select("match_id", F.explode(sid).alias("steamid")).where("steamid <> ''").distinct()


def match_header(docs: DataFrame) -> DataFrame:
    """Map and server of the first statistics entry."""
    info = F.try_element_at("CSstats_info", F.lit(1))
    return docs.where("CSstats_info is not null").groupBy("match_id").agg(
        F.min(info["map"]).alias("map_name"), F.min(info["server"]).alias("server_name"))
