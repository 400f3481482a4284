"""Written intermediate tables: they cut lineage and survive the loss of executors."""

import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="spark-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tickscope/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> str:
    """Write to a fresh folder and return its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class WorkScope:
    """Intermediate tables of one computation in one folder, removed together when its results are written."""

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark, self.path, self._n = spark, new_path(spark, name), count()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{next(self._n)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "WorkScope":
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


Keep = Callable[[DataFrame, str], DataFrame]


def lazy(df: DataFrame, name: str) -> DataFrame:
    """The other choice beside ``materialize``: leave the plan as it is."""
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read back with the same schema."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(store(df, name))
