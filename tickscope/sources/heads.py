"""A data source of files and their first bytes: lists a folder, opens only what a filter leaves, reads no more than asked.

    heads.file_heads(spark, "/replays", "*.dem", 8).where("length >= 8 and path like '%/2024/%'")

Conditions on ``path`` (equal, in, starts with, ends with, contains) and lower bounds of ``length`` are decided on the listing, before any file is opened.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import timezone
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringContains,
                                    StringEndsWith, StringStartsWith)

from tickscope.sources.paths import listing, open_file

SCHEMA = "path string, modified_time timestamp, length long, head binary"
#: Files that one task opens.
FILES_PER_TASK = 500


@dataclass
class Chunk(InputPartition):
    files: list


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.patterns = options["path"], options.get("glob", "*").split(",")
        self.n_bytes, self.per_task = int(options.get("bytes", 0)), int(options.get("files_per_task", FILES_PER_TASK))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        on_text = {EqualTo: lambda p, v: p == v, In: lambda p, v: p in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda p, v: v in p}
        on_size = {GreaterThan: lambda n, v: n > v, GreaterThanOrEqual: lambda n, v: n >= v}
        for f in filters:
            if f.attribute == ("path",) and type(f) in on_text:
                self.tests.append((0, on_text[type(f)], f.value))
            elif f.attribute == ("length",) and type(f) in on_size:
                self.tests.append((2, on_size[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        found = [f for f in listing(self.root) if any(fnmatch(f[0].rsplit("/", 1)[-1], p) for p in self.patterns)
                 and all(test(f[at], value) for at, test, value in self.tests)]
        return [Chunk(found[i:i + self.per_task]) for i in range(0, len(found), self.per_task)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path, modified, length in partition.files:
            head = None
            if self.n_bytes:
                with open_file(path) as f:
                    head = f.read(self.n_bytes)
            yield path, modified.astimezone(timezone.utc), length, head


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def file_heads(spark: SparkSession, path: str, glob: str = "*", n_bytes: int = 0) -> DataFrame:
    """Files below ``path`` (path, modified_time, length) with their first ``n_bytes`` (head, null for 0). ``glob``: patterns of names, separated by commas.

    Turns on filter pushdown for Python sources in this session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("glob", glob).option("bytes", n_bytes).load(path)
