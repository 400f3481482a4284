"""File listings: replay catalog, header check, pairing of tick and metadata files."""

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.operators.blocks import block_index
from tickscope.sources.paths import folder_entries, open_file
from tickscope.sources.sinks import file_tasks
from tickscope.sources.workdir import materialize

MAGIC_HEX = "504244454D533200"  # fixed value: first eight bytes of a complete replay
MAP_PATTERN = r"((?:de|cs)_[a-zA-Z0-9_]+)"
INFO_BYTES = 8192
#: Rows that a listing hands on at once.
LISTED_ROWS = 10_000


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, modified_time, length of the files of one or more folders, or of files named themselves, in one listing. The content column is
    never selected, so no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", recursive).load(paths if isinstance(paths, str) else list(paths)).select(
        "path", F.col("modificationTime").alias("modified_time"), "length")


def list_tree(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files below ``folder`` as ``list_files`` gives them (those of no bytes are left out), listed by tasks: level by level, each folder by one task, its rows
    written to the shared folder. The driver holds no file, where a scan's listing holds them all and makes a task of every few files.
    ``glob``: patterns of names, separated by commas.
    """
    patterns = glob.split(",")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []

        def part(size: int) -> Iterator[pd.DataFrame]:
            while len(found) >= size:
                yield pd.DataFrame(found[:LISTED_ROWS], columns=["path", "modified_time", "length", "folder"]).astype({"length": "Int64"})
                del found[:LISTED_ROWS]

        for b in batches:
            for above in b["path"]:
                found += [e for e in folder_entries(above) if e[3] or e[2] and any(fnmatch(e[0].rsplit("/", 1)[-1], p) for p in patterns)]
                yield from part(LISTED_ROWS)
        yield from part(1)

    folders, levels = spark.createDataFrame([(folder,)], "path string"), []
    while not levels or not folders.isEmpty():
        spread = folders.select("path").repartition(file_tasks(spark), "path")
        levels.append(materialize(spread.mapInPandas(look, "path string, modified_time timestamp, length long, folder boolean"), "listing"))
        folders = levels[-1].where("folder")
    return reduce(DataFrame.unionByName, levels).where("not folder").drop("folder")


def with_head(files: DataFrame, n_bytes: int) -> DataFrame:
    """Adds ``head``, the first bytes of each file, reading no more than those."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = []
            for p in b["path"]:
                with open_file(p) as f:
                    heads.append(f.read(n_bytes))
            yield b.assign(head=heads)

    return files.mapInPandas(read, T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())]))


def valid_header(files: DataFrame, head: str = "head", magic_hex: str = MAGIC_HEX) -> DataFrame:
    """Complete replays: long enough and starting with the magic bytes."""
    start = F.substring(F.col(head), 1, len(magic_hex) // 2)
    return files.where((F.col("length") >= 8) & (start == F.unhex(F.lit(magic_hex))))


def replay_catalog(replays: DataFrame, infos: DataFrame | None = None) -> DataFrame:
    """Catalog of ``*.dem`` files, newest first; map from the companion ``.info`` head, else from the file name."""
    name = F.element_at(F.split("path", "/"), -1)
    d = replays.withColumn("file_name", name).where(F.lower("file_name").endswith(".dem"))
    if infos is not None:
        text = F.decode(F.substring(F.col("head"), 1, INFO_BYTES), "ISO-8859-1")
        side = infos.where(F.col("path").endswith(".info")).select(
            F.regexp_replace("path", r"\.info$", "").alias("path"),
            F.nullif(F.regexp_extract(text, MAP_PATTERN, 1), F.lit("")).alias("_info_map"))
        d = d.join(side, "path", "left")
    else:
        d = d.withColumn("_info_map", F.lit(None).cast("string"))
    from_name = F.lower(F.nullif(F.regexp_extract("file_name", "(?i)" + MAP_PATTERN, 1), F.lit("")))
    return d.select("path", "file_name", "length", "modified_time",
                    F.coalesce("_info_map", from_name).alias("map_name")).orderBy(F.desc("modified_time"), "path")


def with_position(catalog: DataFrame, name: str = "position") -> DataFrame:
    """Adds the place in the catalog's order, newest first: ranked day by day, so no task holds the whole catalog."""
    day = -F.floor(F.unix_seconds("modified_time") / 86400)
    order = -F.unix_micros("modified_time")
    d = block_index(catalog.withColumns({"_all": F.lit(1), "_order": order}), {"_p": F.lit(1)}, ["_all"], ("_order", "path"), block=day)
    return d.withColumn(name, F.col("_p_i")).drop("_all", "_order", "_p_i", "_p_n", "_blk")


def discover_pairs(files: DataFrame) -> DataFrame:
    """Tick file and metadata file per (class folder, base name), Parquet before CSV.GZ, with a status.

    One aggregation over the listing does the full outer pairing.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"\.(parquet|csv\.gz|json)$", 1)
    d = files.select("path", F.element_at(parts, -2).alias("match_category"), ext.alias("ext"),
                     F.regexp_replace(name, r"\.(parquet|csv\.gz|json)$", "").alias("base")).where("ext <> ''")
    rank = F.when(F.col("ext") == "parquet", 1).when(F.col("ext") == "csv.gz", 2)
    p = d.groupBy("match_category", "base").agg(
        F.min_by("path", rank).alias("data_path"),
        F.min(F.when(F.col("ext") == "json", F.col("path"))).alias("metadata_path"),
        F.count_if(F.col("ext") == "parquet").alias("parquet_files"), F.count_if(F.col("ext") == "csv.gz").alias("csv_gz_files"))
    status = (F.when(F.col("metadata_path").isNull(), "missing_json").when(F.col("data_path").isNull(), "orphan_json")
              .otherwise("paired"))
    return p.withColumn("status", status)
