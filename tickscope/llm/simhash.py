"""SimHash of word shingles and near duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are dealt by the population counts of their four 16-bit parts. Two fingerprints whose counts differ
by more than the radius in all (summed over the parts) differ by more bits than that, so only tiles of neighbouring counts
meet. Tiles have a bounded size, and their pairs are dealt by groups of tiles of both sides, so that equal counts of very many fingerprints
are the work of many tasks. Tiles are compared with exclusive-or and bit counts; a task returns a spanning forest, not pairs.

Defined cases: a text without words, null included, has fingerprint zero and is linked like any other; fewer words than a shingle
give one shingle of them all. Rows without an id get a fingerprint, but are in no component. Repeated ids are one node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.llm.arrow import with_columns
from tickscope.llm.components import components
from tickscope.llm.forest import Union
from tickscope.sources.workdir import materialize

SEED = 42
HASHES_AT_ONCE = 1 << 16
PARTS = 4
_PLACE = 64  # of a part's count in the number that stands for all four; counts and their steps stay within it
#: Tiles of either side that meet in one deal.
TILES_AT_ONCE = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII only: A-Z, and white space 09-0D and 20
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(shingle, len(words))
    total, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, HASHES_AT_ONCE):
        part = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at:min(n, at + HASHES_AT_ONCE)], ends[at + k - 1:])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, plus ``fp``: the fingerprint's 64 bits as a signed long."""

    def run(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)]

    return with_columns(docs, text_col, {"fp": "long"}, run, keep=[c for c in docs.columns if c != text_col])


def _counts(fp: Column) -> Column:
    """The population counts of the four parts as one number."""
    parts = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") * _PLACE**k for k in range(PARTS)]
    return sum(parts[1:], parts[0])


def _steps(radius: int) -> list[int]:
    """Differences of population counts within the radius, one of each pair of opposite ones. A count below zero borrows from the next
    place and leaves a number that no fingerprint has."""
    every = itertools.product(range(-radius, radius + 1), repeat=PARTS)
    return [sum(d * _PLACE**k for k, d in enumerate(s)) for s in every if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out_a, out_b = [], []
            for left, right, same in zip(pdf["x"], pdf["y"], pdf["same"]):
                x, y = np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                i, j = np.nonzero(near)
                if same:
                    i, j = i[j > i], j[j > i]
                if len(i):
                    both = np.concatenate([x, y]).view(np.int64)
                    forest = Union(len(both))
                    forest.add(i, j if same else j + len(x))
                    a, b = forest.links()
                    out_a.append(both[a])
                    out_b.append(both[b])
            none = [np.zeros(0, np.int64)]
            yield pd.DataFrame({"a": np.concatenate(out_a or none), "b": np.concatenate(out_b or none)})

    return run


def tile_pairs(prints: DataFrame, radius: int = 2, tile: int = 1024) -> DataFrame:
    """``x, y, same``: every pair of tiles of fingerprints ``fp`` that may hold a link, once."""
    own = prints.withColumn("counts", _counts(F.col("fp")))
    # at most 17^4 different counts: these tables of one row for each may be broadcast
    sizes = materialize(own.groupBy("counts").agg(F.ceil(F.count("*") / tile).alias("tiles")), "tile_counts")
    tiles = materialize(own.join(F.broadcast(sizes), "counts").groupBy("counts", F.pmod(F.xxhash64("fp", F.lit(3)), "tiles").alias("chunk")).agg(
        F.collect_list("fp").alias("fps")), "tiles").withColumn("group", F.floor(F.col("chunk") / TILES_AT_ONCE))
    steps = F.explode(F.array(*map(F.lit, _steps(radius))))
    groups = sizes.select("counts", F.ceil(F.col("tiles") / TILES_AT_ONCE).alias("groups"))
    reach = groups.select("counts", "groups", steps.alias("step")).groupBy((F.col("counts") + F.col("step")).alias("counts")).agg(
        F.max("groups").alias("reach"))
    goes = tiles.select(F.col("fps").alias("x"), F.col("chunk").alias("x_chunk"), F.col("counts").alias("x_counts"), F.col("group").alias("x_group"),
                        steps.alias("step")).withColumn("counts", F.col("x_counts") + F.col("step")).join(F.broadcast(groups), "counts").withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    meets = tiles.join(F.broadcast(reach.join(sizes, "counts", "left_semi")), "counts").select(
        F.col("fps").alias("y"), "chunk", "counts", "group", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("x_group"))
    # few bytes are much work: a number of partitions that is given is not reduced by adaptive execution
    deal, parts = ["counts", "group", "x_group"], int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = goes.repartition(parts, *deal).hint("merge").join(meets.repartition(parts, *deal), deal).where((F.col("step") != 0) | (F.col("x_chunk") <= F.col("chunk")))
    return met.select("x", "y", ((F.col("step") == 0) & (F.col("x_chunk") == F.col("chunk"))).alias("same"))


def near_links(prints: DataFrame, radius: int = 2, tile: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect exactly those within ``radius`` bits, in the sense of components."""
    return tile_pairs(prints, radius, tile).mapInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the component is the smallest id reachable over fingerprints within ``radius`` bits."""
    own = materialize(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", shingle), "prints")
    distinct = materialize(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct_prints")
    links = materialize(near_links(distinct.select("fp"), radius), "near")
    # components over representatives: their smallest one is the smallest id of all, as each is the smallest of its fingerprint
    ends = (links.join(distinct.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
            .join(distinct.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    member = distinct.join(components(ends).withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    # the same id in several rows joins what it stands for only where their fingerprints are linked
    return own.join(member, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
