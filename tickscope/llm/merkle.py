"""Merkle manifest of a dataset, its nodes labelled with the interval of leaf ranks that they cover.

Rows are leaves, ranked inside their tree (one per language) by id. A node of level k covers an interval of FAN^k ranks, less at the right end. Levels are
built and read in bands of BAND levels: a bucket, the part of a tree under one node at the top of a band, holds at most FAN^BAND nodes of the
band's lowest level, so no key of a grouping or join grows with the table, however large a tree is.

Proofs run from the top band down. Inside a bucket, a containment join attaches to each lowest node its ancestors, the nodes whose interval
contains its own; the siblings on the way are what the parent's interval has besides the node's own, left and right. A bucket's nodes then
continue with the path of the bucket's top. Subroots are the leaves of one more tree, built and read by the same functions.

Defined cases: null fields enter as ``-``; a null language is a tree of its own, first among trees; null ids come first, equal ids are ordered by
their leaf, so rows that are equal in all fields are interchangeable; an empty table gives no row. Columns besides the five fields are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.sources.workdir import materialize

FAN, BAND = 2, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<level:int,left:string,right:string>>"


class Forest(NamedTuple):
    """Nodes (_tree, _bucket, level, lo, hi, hash, _n, _h) per band of levels, and the top of each tree (_tree, top)."""
    bands: list[DataFrame]
    tops: DataFrame


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(changed: dict[str, Column] | None = None) -> Column:
    return digest(*[field((changed or {}).get(c, F.col(c))) for c in FIELDS])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` plus ``lo`` (0, 1, ... in each ``_tree`` by ``order``) and ``_n``, the rows of the tree: sorted by ranges, counted per part."""
    by = ["_tree", *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = materialize(placed, "ranked")
    parts = placed.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_tree")
    parts = parts.select("_tree", "_part", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"),
                         F.sum("_rows").over(whole).alias("_n"))
    return placed.join(parts, ["_tree", "_part"]).withColumn("lo", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _height(n: Column) -> Column:
    powers = F.array(*[F.lit(FAN ** k) for k in range(62) if FAN ** k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def _raised(hashes: Column) -> Column:
    """The level above: every FAN consecutive nodes become one."""
    return F.transform(F.sequence(F.lit(0), ((F.size(hashes) - 1) / FAN).cast("int")),
                       lambda i: F.sha2(F.array_join(F.slice(hashes, i * FAN + 1, FAN), ""), 256))


def _band(entries: DataFrame, b: int) -> DataFrame:
    """All nodes of band ``b`` from its lowest level (_tree, lo, hash, _n, _h)."""
    unit = FAN ** (BAND * b)
    wide = unit * FAN ** BAND
    spans = F.array(*[F.lit(unit * FAN ** k).cast("long") for k in range(BAND + 1)])
    rise = F.least(F.lit(BAND), F.col("_h") - BAND * b)
    grouped = entries.groupBy("_tree", F.expr(f"lo div {wide}").alias("_bucket")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hash"))).alias("_run"), F.first("_n").alias("_n"), F.first("_h").alias("_h"))
    steps = F.when(rise > 0, F.sequence(F.lit(1), rise)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(F.col("_run.hash")), lambda done, _: F.concat(done, F.array(_raised(F.element_at(done, -1)))))
    each = grouped.select("_tree", "_bucket", "_n", "_h", F.posexplode_outer(levels).alias("_l", "_hashes")).select(
        "_tree", "_bucket", "_n", "_h", "_l", F.posexplode_outer("_hashes").alias("_i", "hash"))
    span = F.get(spans, F.col("_l"))
    lo = F.col("_bucket") * wide + F.col("_i") * span
    return each.select("_tree", "_bucket", (F.col("_l") + BAND * b).alias("level"), lo.alias("lo"), F.least(lo + span, F.col("_n")).alias("hi"), "hash", "_n", "_h")


def build(leaves: DataFrame) -> Forest:
    """Nodes over ``leaves`` (_tree, lo, hash, _n)."""
    entries = leaves.select("_tree", "lo", "hash", "_n", _height(F.col("_n")).alias("_h"))
    deepest = leaves.agg(_height(F.coalesce(F.max("_n"), F.lit(0)))).first()[0]
    bands, tops = [], []
    for b in range(max(1, -(-deepest // BAND))):
        nodes = materialize(_band(entries, b), "nodes")
        bands.append(nodes)
        tops.append(nodes.where(F.col("level") == F.col("_h")).select("_tree", F.col("hash").alias("top")))
        entries = nodes.where((F.col("level") == BAND * (b + 1)) & (F.col("_h") > BAND * (b + 1))).select("_tree", "lo", "hash", "_n", "_h")
    every = tops[0]
    for t in tops[1:]:
        every = every.union(t)
    return Forest(bands, every)


def _sides(nodes: DataFrame) -> DataFrame:
    """(_tree, _bucket, level, lo, hi, left, right) of nodes below the band's top: the hashes that their parent's interval has besides their own."""
    span = F.expr(f"element_at(array({', '.join(f'{FAN ** (k + 1)}L' for k in range(61) if FAN ** (k + 1) < 1 << 62)}), level + 1)")
    parent = F.expr("lo div _span") * F.col("_span")
    run = F.collect_list(F.struct("lo", "hi", "hash")).over(Window.partitionBy("_tree", "_bucket", "level", "_parent"))
    below = nodes.where(F.col("level") < F.col("_h")).withColumn("_span", span).withColumn("_parent", parent).withColumn("_run", F.sort_array(run))
    left = F.filter("_run", lambda x: x["hi"] <= F.col("lo"))["hash"]
    right = F.filter("_run", lambda x: x["lo"] >= F.col("hi"))["hash"]
    return below.select("_tree", "_bucket", "level", "lo", "hi", F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def with_paths(leaves: DataFrame, forest: Forest, above: DataFrame) -> DataFrame:
    """``leaves`` (_tree, lo and more) with ``path``, their siblings from the leaf up (level, left, right), and the columns of ``above``.

    ``above`` has one row per ``_tree``: a ``path`` that goes on where the tree ends, and more. Every band joins by buckets of bounded size.
    """
    extra = [c for c in above.columns if c not in ("_tree", "path")]
    tall = forest.bands[0].where("level = _h").select("_tree", "_h")
    for nodes in forest.bands[1:]:
        tall = tall.union(nodes.where("level = _h").select("_tree", "_h"))
    above = above.join(tall, "_tree")
    upper = None
    for b in reversed(range(len(forest.bands))):
        low, wide, nodes = BAND * b, FAN ** (BAND * (b + 1)), forest.bands[b].repartition("_tree", "_bucket")
        ends_here = (F.col("_h") <= low + BAND) & ((F.col("_h") > low) | F.lit(b == 0))
        starts = above.where(ends_here).select("_tree", F.lit(0).cast("long").alias("_bucket"), "path", *extra)
        upper = starts if upper is None else starts.unionByName(upper)
        base = leaves.withColumn("_bucket", F.expr(f"lo div {wide}")) if b == 0 else nodes.where(F.col("level") == low).select("_tree", "_bucket", "lo")
        payload = [c for c in base.columns if c not in ("_tree", "_bucket", "lo")]
        way = _sides(nodes.where(F.col("level") < low + BAND))
        inside = ((F.col("e._tree") == F.col("a._tree")) & (F.col("e._bucket") == F.col("a._bucket")) & (F.col("a.lo") <= F.col("e.lo")) & (F.col("e.lo") < F.col("a.hi")))
        step = F.struct("a.level", "a.left", "a.right")
        found = base.alias("e").join(way.alias("a"), inside, "left").groupBy("e._tree", "e._bucket", "e.lo").agg(
            F.sort_array(F.collect_list(F.when(F.col("a.level").isNotNull(), step))).cast(PATH).alias("_own"), *[F.first(f"e.{c}").alias(c) for c in payload])
        joined = found.join(upper.withColumnRenamed("path", "_more"), ["_tree", "_bucket"])
        path = F.concat("_own", "_more").alias("path")
        if b:
            upper = joined.select("_tree", (F.expr(f"lo div {FAN ** low}")).alias("_bucket"), path, *extra)
        else:
            upper = joined.select("_tree", "lo", *payload, path, *extra)
    return upper


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def manifest(docs: DataFrame) -> tuple[DataFrame, Forest, Forest]:
    """Ranked leaves (_tree, lo, _n, doc_id, hash, tampered), the forest of languages and the tree of their subroots. ``tampered`` is the leaf after
    n_chars grew by one, in rows where 7 divides the checksum of the id, else null."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = materialize(docs.select(tree.alias("_tree"), "doc_id", leaf_hash().alias("hash"), F.when(touched, leaf_hash(more)).alias("tampered")), "leaves")
    leaves = materialize(ranked(leaves, ["doc_id", "hash"]), "leaves")
    forest = build(leaves)
    tops = materialize(forest.tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("of"), F.col("top").alias("hash")), "tops")
    tops = materialize(ranked(tops, ["of"]), "tops")
    return leaves, Forest(forest.bands, tops), build(tops)


def proofs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 of the untampered table, and the root that the tampered (or else the original) leaf folds to."""
    leaves, forest, roots = manifest(docs)
    start = roots.tops.select("_tree", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    trees = with_paths(forest.tops.select("_tree", "lo", "of", "hash"), roots, start)
    above = materialize(trees.select(F.col("of").alias("_tree"), "path", F.col("hash").alias("subroot"), "root"), "above")
    found = with_paths(leaves.select("_tree", "lo", "doc_id", "hash", "tampered"), forest, above)
    seen = found.withColumn("folded_root", folded(F.coalesce("tampered", "hash"), F.col("path")))
    return seen.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
