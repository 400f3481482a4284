"""Incremental arrival of replays and tick files with Structured Streaming.

A folder is watched by polls: each appends (path, length, modified_time, polled) of the files it finds to a table. ``settled`` follows every file through the
polls and lets it pass once it is written to the end; what it knows of a file is state in the checkpoint. The clock is that of the polls and notices,
never the processing clock, so a stream that starts late or runs again comes to the same results.
"""

from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickscope.plans.analyze import analyse, prepare
from tickscope.sources.files import MAGIC_HEX, list_files, valid_header, with_head
from tickscope.sources.ticks import read_ticks
from tickscope.sources.workdir import WorkScope

POLL_SCHEMA = "path string, length long, modified_time timestamp, polled timestamp"
#: Folders that the index of files by match is dealt into: a batch reads those of its matches.
INDEX_BUCKETS = 64


def file_arrivals(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """Stream of new files (path, modified_time, length, arrived), none of them opened.

    Spark forgets files older than ``maxFileAge`` unless it takes the latest first with a limit per trigger; then it remembers every file in the
    checkpoint and a file's own time never matters. Copies keep old times, so that is what is wanted here.
    """
    return (spark.readStream.format("binaryFile")
            .schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", per_trigger).option("latestFirst", True).load(folder)
            .select("path", F.col("modificationTime").alias("modified_time"), "length", F.current_timestamp().alias("arrived")))


def replay_arrivals(spark: SparkSession, folder: str, glob: str = "*.dem", per_trigger: int = 100) -> DataFrame:
    return file_arrivals(spark, folder, glob, per_trigger)


def complete_only(files: DataFrame, magic_hex: str = MAGIC_HEX) -> DataFrame:
    """Files of eight bytes or more with the right first eight bytes; no more of a file is read."""
    return valid_header(with_head(files.where("length >= 8"), 8), magic_hex=magic_hex).drop("head")


def record_poll(spark: SparkSession, folder: str, polls: str, glob: str = "*", at: datetime | None = None, horizon: str | None = None) -> None:
    """Append one look at ``folder`` to the table ``polls``. With ``horizon`` (like ``1 hour``) only files modified in that time are noted, so a poll
    of a folder with a long past stays small."""
    polled = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    found = list_files(spark, folder, glob, recursive=True).withColumn("polled", polled)
    if horizon:
        found = found.where(F.col("modified_time") >= F.col("polled") - F.expr(f"interval {horizon}"))
    found.select("path", "length", "modified_time", "polled").write.mode("append").parquet(polls)


def poll_stream(spark: SparkSession, polls: str, per_trigger: int = 1000) -> DataFrame:
    """The recorded polls as a stream, oldest first, however old."""
    return (spark.readStream.schema(POLL_SCHEMA).option("maxFilesPerTrigger", per_trigger).option("maxFileAge", "36500d")
            .option("recursiveFileLookup", True).parquet(polls))


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


def _in_order(pdfs: Iterator[pd.DataFrame], time: str) -> tuple[pd.DataFrame, list[tuple]]:
    """Rows of one file in a batch, and (time, length, time of change, place) of each in the order of time; a batch holds a bounded number of polls.

    A group is a few rows, so its cost is the number of pandas calls: columns are taken out once and ordered as tuples.
    """
    frames = list(pdfs)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return rows, sorted(zip(_micros(rows[time]).tolist(), rows["length"].tolist(), _micros(rows["modified_time"]).tolist(), range(len(rows))))


def _seconds(duration: str) -> float:
    return pd.Timedelta(duration).total_seconds()


def _until(state: GroupState, micros: int) -> None:
    """Wake up when the watermark has passed ``micros``."""
    state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs() + 1))


#: Groups that the files of a stream are dealt into by their paths, each with one row of state. A running stream cannot change it.
FILE_BUCKETS = 1024
#: One entry per file of the bucket in each array; ``timer`` in milliseconds, the other times in microseconds.
SETTLED_STATE = ("path array<string>, since array<long>, seen array<long>, size array<long>, modified array<long>, stable array<long>, done array<boolean>, "
                 "last array<long>, timer array<long>")


def _polls_in_order(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(path, time, length, time of change) of the polls of a bucket, file by file and each file's in the order of time."""
    numbers: dict[str, int] = {}
    parts = [np.empty((4, 0), "int64")]
    for rows in pdfs:
        at = [numbers.setdefault(p, len(numbers)) for p in rows["path"]]
        parts.append(np.array([at, _micros(rows["polled"]), rows["length"].to_numpy(), _micros(rows["modified_time"])], "int64"))
    polls = np.concatenate(parts, axis=1)
    order, paths = np.lexsort(polls[::-1]), list(numbers)
    for i in range(0, len(order), 10_000):
        for number, at, length, changed in polls[:, order[i:i + 10_000]].T.tolist():
            yield paths[number], at, length, changed


def settled(polls: DataFrame, checks: int = 2, timeout: str = "2 seconds", min_size: int = 8, memory: str = "1 hour", late: str = "10 seconds",
            buckets: int = FILE_BUCKETS) -> DataFrame:
    """(path, length, modified_time, polled, outcome) of a stream of polls: ``complete`` for a file that ``checks`` polls in a row found as large as the poll
    before, ``timeout`` for one that did not get there within ``timeout`` of its first poll.

    A file shorter than ``min_size`` only waits. After a timeout the next poll begins anew. A complete file is reported once per size and time of change, as long
    as polls go on to see it; ``memory`` after the last one it is forgotten. The timers are event-time timers: they go by the latest poll, less ``late``.

    A call into Python and its state cost some milliseconds, a file in it some microseconds: so files are followed by the bucket, each with a timer of its own.
    """
    limit, kept = int(_seconds(timeout) * 1e6), int(_seconds(memory) * 1e6)

    def follow(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        files = {path: known for path, *known in zip(*state.get)} if state.exists else {}
        watermark = state.getCurrentWatermarkMs()

        def report(path: str, seen: int, modified: int, at: int, outcome: str) -> None:
            out.append((path, seen, modified, at, outcome))

        looked = set()
        for path, polls_of in groupby(() if state.hasTimedOut else _polls_in_order(pdfs), itemgetter(0)):
            looked.add(path)
            since, seen, size, modified, stable, done, last, _ = files.get(path, (None, None, None, None, 0, False, None, None))
            for _, at, length, changed in polls_of:
                if since is not None and not done and at - since > limit:
                    report(path, seen, modified, since + limit, "timeout")
                    since = None
                if since is None or done and (length, changed) != (seen, modified):
                    since, size, stable, done = at, None, 0, False
                seen, modified, last = length, changed, at
                if length < min_size or done:
                    continue
                stable = stable + 1 if length == size else 0
                size = length
                if stable >= checks:
                    done = True
                    report(path, seen, modified, at, "complete")
            due = last + kept if done else since + limit
            files[path] = since, seen, size, modified, stable, done, last, max(due // 1000, watermark + 1)
        for path in [p for p, known in files.items() if known[-1] < watermark and p not in looked]:
            since, seen, _, modified, _, done, _, _ = files.pop(path)
            if not done:
                report(path, seen, modified, since + limit, "timeout")
        if files:
            state.update(([*files], *map(list, zip(*files.values()))))
            state.setTimeoutTimestamp(min(known[-1] for known in files.values()))
        else:
            state.remove()
        if out:
            path, length, changed, at, outcome = zip(*out)
            yield pd.DataFrame({"path": path, "length": length, "modified_time": np.array(changed, "datetime64[us]"), "polled": np.array(at, "datetime64[us]"), "outcome": outcome})

    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets))
    return polls.withWatermark("polled", late).withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        follow, f"{POLL_SCHEMA}, outcome string", SETTLED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(files: DataFrame, cooldown: str = "5 seconds", memory: str = "60 seconds") -> DataFrame:
    """Notices of a file, but not the same (size, time of change) again within ``cooldown`` of the last one that passed.

    After the cooldown the same notice passes again. What passed last is state per path and forgotten ``memory`` after it. The clock is
    the time of arrival, never a file's own time, so a file that was not seen before passes however old it is.
    """
    if "arrived" not in files.columns:
        files = files.withColumn("arrived", F.current_timestamp())
    pause, kept = int(_seconds(cooldown) * 1e6), int(_seconds(memory) * 1e6)

    def passed(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, ordered = _in_order(pdfs, "arrived")
        size, modified, at = state.get if state.exists else (None, None, None)
        let = []
        for now, length, changed, place in ordered:
            again = at is not None and (length, changed) == (size, modified) and now - at < pause
            if not again:
                let.append(place)
                size, modified, at = length, changed, now
        state.update((size, modified, at))
        _until(state, at + kept)
        if let:
            yield rows.iloc[let]

    return files.withWatermark("arrived", memory).groupBy("path").applyInPandasWithState(
        passed, files.schema, "size long, modified long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def _plain_path(uri: Column) -> Column:
    """A file's address in metadata as a path that readers take."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def index_files(ticks: DataFrame, index: str, batch_id: int) -> None:
    """Note which files hold which matches, as one more batch of the index. A batch that is repeated writes the same place."""
    pairs = ticks.select("match_id", _plain_path(F.col("source_file")).alias("path")).distinct()
    pairs.withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(INDEX_BUCKETS))).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{index}/batch={batch_id}")


def files_of(spark: SparkSession, index: str, matches: DataFrame) -> list[str]:
    """Paths of all files of ``matches``, which are in the index. Only the matches' buckets are read."""
    buckets = [r["bucket"] for r in matches.select(F.pmod(F.xxhash64("match_id"), F.lit(INDEX_BUCKETS)).alias("bucket")).distinct().collect()]
    known = spark.read.schema("match_id string, path string").parquet(*[f"{index}/batch=*/bucket={b}" for b in sorted(buckets)])
    return sorted(r["path"] for r in known.join(matches, "match_id", "left_semi").select("path").distinct().collect())


def analyse_on_arrival(spark: SparkSession, polls: str, fires_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                       match_column: bool = True, per_trigger: int = 1000, settle: dict | None = None, **options) -> StreamingQuery:
    """Verdicts of every match that has new tick files, under ``out``/players, /matches and /events; read them with ``latest_results``.

    ``polls`` is the table that ``record_poll`` fills; only files that are ``settled`` (options ``settle``) are taken. A batch says which matches have
    changed. Each of them is analysed anew from all its files, those of earlier batches included, so a match may arrive in any number of files and batches. An
    index of files by match beside the checkpoint names them: a batch opens its new files and the files of its matches, nothing else, whatever the folder
    holds. The driver lists those files, as it does for any scan. ``fires_of`` gives the shots for a frame of ticks. A batch that is repeated
    after a failure overwrites its own folders; ``out``/log has what each batch read.
    """
    index = f"{checkpoint.rstrip('/')}-files"

    def handle(batch: DataFrame, batch_id: int) -> None:
        with WorkScope(spark, "arrival") as work:
            fresh = sorted(r["path"] for r in work.keep(batch.where("outcome = 'complete'").select("path").distinct(), "fresh").collect())
            if not fresh:
                return
            pairs = work.keep(read_ticks(spark, fresh, match_column).select("match_id", "source_file").distinct(), "pairs")
            index_files(pairs, index, batch_id)
            changed = work.keep(pairs.select("match_id").distinct(), "changed")
            paths = files_of(spark, index, changed)
            clean = work.keep(prepare(read_ticks(spark, paths, match_column).join(changed, "match_id", "left_semi")), "ticks")
            for name, df in analyse(clean, fires_of(clean), keep=work.keep, **options)._asdict().items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            changed.agg(F.count(F.lit(1)).alias("matches")).select("matches", F.lit(len(fresh)).cast("long").alias("new_files"), F.lit(len(paths)).cast("long").alias(
                "files_read")).write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")

    return on_arrival(settled(poll_stream(spark, polls, per_trigger), **(settle or {})), handle, checkpoint)


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of each match from the last batch that analysed it."""
    every = spark.read.parquet(path)
    last = every.groupBy("match_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["match_id", "batch"], "left_semi").drop("batch")


def on_arrival(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``handle`` once per batch; the checkpoint remembers which files are done."""
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
