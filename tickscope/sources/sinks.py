"""Writers and their readers. Spark's commit protocol makes each write of a table atomic; single files (``write_texts``) appear one by one, each whole."""

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.functions.text import safe_file_name
from tickscope.operators.blocks import PLAYER
from tickscope.sources.paths import new_file, partition_folder

MANIFEST_SCHEMA = """match_id string, match_category string, data_path string, metadata_path string, label string,
  label_confidence string, label_source string, cheaters string, num_cheaters int, usable_for_training boolean,
  split string"""
MANIFEST_COLUMNS = [c.split()[0] for c in MANIFEST_SCHEMA.replace("\n", " ").split(",")]


def write_ticks(ticks: DataFrame, path: str) -> None:
    """Tick table clustered by match and tick: filters on a match or a span skip row groups, and a large match is
    spread over many files."""
    ticks.repartitionByRange("match_id", "tick").sortWithinPartitions("match_id", "tick").write.parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*MANIFEST_COLUMNS).orderBy("match_id").write.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest with ``cheaters`` as an array; blanks and "nan" are no ids."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)
    return m.withColumn("cheaters", cheater_array("cheaters"))


def cheater_array(column: str):
    ids = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(ids, lambda x: (x != "") & (x != "nan"))


def write_features(features: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Feature table, and one row of metadata beside it."""
    spark = features.sparkSession
    features.write.parquet(f"{path}/features")
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()]).write.json(f"{path}/meta")


def read_features(spark: SparkSession, path: str, expected: dict[str, str] | None = None) -> DataFrame:
    meta = spark.read.json(f"{path}/meta").first().asDict()
    for k, v in (expected or {}).items():
        if meta.get(k) != v:
            raise ValueError(f"feature table was written with {k}={meta.get(k)}, expected {v}")
    return spark.read.parquet(f"{path}/features")


def features_for(spark: SparkSession, path: str, expected: dict[str, str], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(features, reused): the table at ``path`` if it was written for the same manifest and schema, else a new one from ``build``.

    The table of other metadata stays as it is; the new one goes into a folder named by its own metadata.
    """
    name = sha256("|".join(f"{k}={v}" for k, v in sorted(expected.items())).encode()).hexdigest()[:16]
    for place in (path, f"{path}-{name}"):
        try:
            return read_features(spark, place, expected), True
        except ValueError:
            continue
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            write_features(build(), place, expected)
            return read_features(spark, place, expected), False
    raise ValueError(f"{path}-{name} holds features of other metadata")


def manifest_hash(manifest: DataFrame) -> str:
    """One text for the content of a manifest, whatever the order of its rows."""
    rows = manifest.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in MANIFEST_COLUMNS if c in manifest.columns]).alias("h"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def write_results(matches: DataFrame, players: DataFrame, events: DataFrame, path: str, page: int = 1000) -> None:
    """Nested results as gzip JSON lines.

    A player document carries at most ``page`` events; further events go to further documents that name only the
    player, so no group grows with the data. ``events`` has ``seq``.
    """
    cols = [c for c in events.columns if c not in PLAYER]
    pages = events.withColumn("page", F.floor((F.col("seq") - 1) / page)).groupBy(*PLAYER, "page").agg(
        F.array_sort(F.collect_list(F.struct("seq", *[c for c in cols if c != "seq"]))).alias("combat_events"))
    first = players.join(pages.where("page = 0"), [*PLAYER], "left").withColumn("page", F.coalesce("page", F.lit(0)))
    docs = first.unionByName(pages.where("page > 0"), allowMissingColumns=True)
    docs.write.option("compression", "gzip").json(f"{path}/players")
    matches.write.option("compression", "gzip").json(f"{path}/matches")


def read_results(spark: SparkSession, path: str, matches: DataFrame, players: DataFrame, events: DataFrame):
    """The three frames again; the given frames only lend their schemas."""
    cols = ["seq", *[c for c in events.columns if c not in (*PLAYER, "seq")]]
    ev = ", ".join(f"`{c}`:{dict(events.dtypes)[c]}" for c in cols)
    base = ", ".join(f"`{c}` {t}" for c, t in players.dtypes)
    docs = spark.read.schema(f"{base}, page long, combat_events array<struct<{ev}>>").json(f"{path}/players")
    m = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in matches.dtypes)).json(f"{path}/matches")
    p = docs.where("page = 0").select(*players.columns)
    e = docs.select(*PLAYER, F.inline("combat_events"))
    return m, p, e


def example_manifest(manifest: DataFrame, n: int = 10, folder: str = "data/raw_examples") -> DataFrame:
    """First rows with paths that reveal nothing."""
    return manifest.orderBy("match_id").limit(n).withColumns({
        "data_path": F.concat(F.lit(folder + "/"), F.col("match_id"), F.lit(".parquet")),
        "metadata_path": F.concat(F.lit(folder + "/"), F.col("match_id"), F.lit(".json"))})


def report_files(reports: DataFrame, text: str = "report", name: str = "name") -> DataFrame:
    """(match_id, file_name, value): what ``write_reports`` writes, one folder per match and player; the id keeps namesakes apart."""
    return reports.select("match_id", F.concat(F.lit("Report_"), safe_file_name(name), F.lit("_"), "steamid").alias("file_name"),
                          F.col(text).alias("value"))


def file_tasks(spark: SparkSession) -> int:
    """Tasks that make or delete many small files: a number of its own, because such rows are too few bytes to be spread by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def write_texts(files: DataFrame, root: str, folders: tuple[str, ...] = ()) -> None:
    """One text file per row: ``value`` and a line end at ``path`` below ``root``, in a folder for each value of ``folders`` as partitionBy names them.

    The tasks make the files themselves: Spark's writer starts a writer, sets modes in processes of their own and moves a folder in the driver for each of them.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            above = zip(*[b[f] for f in folders]) if folders else ((),) * len(b)
            for values, name, text in zip(above, b["path"], b["value"]):
                with new_file("/".join([root, *[partition_folder(f, v) for f, v in zip(folders, values)], name])) as out:
                    out.write((text or "").encode() + b"\n")
            yield pd.DataFrame({"n": [len(b)]})

    rows = files.select(*folders, "path", "value").repartition(file_tasks(files.sparkSession), *folders, "path")
    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def write_reports(reports: DataFrame, path: str, text: str = "report", name: str = "name") -> None:
    write_texts(report_files(reports, text, name).withColumn("path", F.lit("report.txt")), path, ("match_id", "file_name"))
