"""Stored results, one folder per key, with retention.

``data/result_key=...`` holds the rows, ``used`` a log of (result_key, last_used), ``tombstones`` the keys that were given up and how recently they had been used
then. A key lives if it was used after its last tombstone. Giving up and deleting are two steps: readers stop seeing a key at once, and files that a reader has
listed before stay until ``purge``. Every step is an append or can be repeated, so a lost executor or driver leaves the store right.
"""

from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.config import DEFAULT
from tickscope.operators.results import retention_victims
from tickscope.sources.files import list_files
from tickscope.sources.paths import delete_folder, delete_others, new_file, partition_folder
from tickscope.sources.sinks import file_tasks

LOG_SCHEMA = "result_key string, last_used timestamp"
FILE = "rows.parquet"


def put(results: DataFrame, store: str) -> None:
    """Write rows (result_key, last_used and more). A key that is there already gets the new rows instead of the old ones.

    The tasks write the files themselves, one per key, and each takes the place of the former one when it is whole. Rows come sorted by key, so a task holds one
    open file and one batch, however many rows a key has.
    """
    root = f"{store}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, writer = None, 0, None
        with ExitStack() as begun:
            for b in batches:
                keys = b.column("result_key").to_pylist()
                rows = pa.Table.from_batches([b]).drop_columns(["result_key"])
                ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
                for start, end in zip([0, *ends], ends):
                    if writer is None or keys[start] != key:
                        begun.close()
                        key, n, folder = keys[start], n + 1, f"{root}/{partition_folder('result_key', keys[start])}"
                        begun.callback(delete_others, folder, FILE)
                        writer = begun.enter_context(pq.ParquetWriter(begun.enter_context(new_file(f"{folder}/{FILE}")), rows.schema))
                    writer.write_table(rows.slice(start, end - start))
        yield pa.RecordBatch.from_pydict({"n": [n]})

    dealt = results.repartition(file_tasks(results.sparkSession), "result_key").sortWithinPartitions("result_key")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    touch(results, store)


def touch(used: DataFrame, store: str) -> None:
    """Note that keys were used (result_key, last_used)."""
    used.groupBy("result_key").agg(F.max("last_used").cast("timestamp").alias("last_used")).write.mode("append").parquet(f"{store}/used")


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        rows = spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LOG_SCHEMA)
    return rows.groupBy("result_key").agg(F.max("last_used").alias("last_used"))


def live_keys(spark: SparkSession, store: str) -> DataFrame:
    """(result_key, last_used) of keys that were used after they were last given up, if ever."""
    gone = _log(spark, f"{store}/tombstones").withColumnRenamed("last_used", "_gone")
    return _log(spark, f"{store}/used").join(gone, "result_key", "left").where("_gone is null or last_used > _gone").drop("_gone")


def data(spark: SparkSession, store: str) -> DataFrame:
    """All rows that lie in the store. The key is text, whatever it looks like."""
    found = spark.read.parquet(f"{store}/data").schema
    whole = T.StructType([T.StructField(f.name, T.StringType() if f.name == "result_key" else f.dataType) for f in found])
    return spark.read.schema(whole).parquet(f"{store}/data")


def read(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the keys that live."""
    return data(spark, store).join(live_keys(spark, store).select("result_key"), "result_key", "left_semi")


def evict(spark: SparkSession, store: str, keep: int = DEFAULT.keep_results) -> None:
    """Give up all but the ``keep`` keys used last. Their files stay until ``purge``."""
    retention_victims(live_keys(spark, store), keep).write.mode("append").parquet(f"{store}/tombstones")


def stored_folders(spark: SparkSession, store: str) -> DataFrame:
    """(result_key, folder) of what lies in the store, alive or not."""
    name = F.regexp_extract("path", r"/result_key=([^/]*)/[^/]*$", 1)
    key = F.url_decode(F.regexp_replace(name, r"\+", "%2B"))
    return list_files(spark, f"{store}/data", "*.parquet", recursive=True).where(name != "").select(
        key.alias("result_key"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct()


def purge(spark: SparkSession, store: str) -> int:
    """Delete the folders of keys that do not live, in the tasks. Returns their number; call it when readers from before ``evict`` are done.

    The log names the keys and a key names its folder, so nothing is listed; a key that is being put and not yet noted is not touched.
    """
    root = f"{store}/data"

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(delete_folder(f"{root}/{partition_folder('result_key', key)}") for key in b["result_key"])]})

    used = _log(spark, f"{store}/used").where("result_key <> ''").select("result_key")
    dead = used.join(live_keys(spark, store).select("result_key"), "result_key", "left_anti").repartition(file_tasks(spark), "result_key")
    return dead.mapInPandas(delete, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
