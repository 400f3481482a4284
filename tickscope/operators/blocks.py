"""Skew-proof ordered computation.

A window over (match, player) puts the whole timeline of one player into one task. Nothing bounds
that timeline, so ordered work is done here on *blocks* that are bounded by construction:

``block_index``   gives every row its dense position within its key. Rows are grouped by
                  (key, order div width), which holds at most ``width`` rows because the order value
                  is unique per key; only one summary row per block (1/65536 of the rows) is
                  accumulated along the key.
``row_blocks``    groups rows by (key, position div size) and copies the few rows next to a block
                  edge into the neighbour, so that lag / lead / bounded frames are exact.
``consecutive_runs``  gaps-and-islands: position minus dense index is constant along a run, so the
                  runs fall out of one partially aggregated groupBy, however long they are.
``exact_percentile``  order statistics by narrowing histograms; no task ever holds all values.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAYER = ("match_id", "steamid")
BEFORE = Window.unboundedPreceding
BLOCK = 65536


def prefix_sums(sizes: DataFrame, keys: Sequence[str], values: Sequence[str], block: str = "_blk") -> DataFrame:
    """Per (key, block): ``<v>_before`` = sum over earlier blocks, ``<v>_n`` = sum over all blocks."""
    keys = list(keys)
    so_far = Window.partitionBy(*keys).orderBy(block).rowsBetween(BEFORE, 0)
    whole = Window.partitionBy(*keys)
    return sizes.select(
        *keys, block,
        *[(F.sum(v).over(so_far) - F.col(v)).alias(f"{v}_before") for v in values],
        *[F.sum(v).over(whole).alias(f"{v}_n") for v in values],
    )


def block_index(df: DataFrame, counters: Mapping[str, Column], keys: Sequence[str] = PLAYER,
                order: Sequence[str] = ("tick",), width: int = BLOCK, block: Column | None = None) -> DataFrame:
    """Add ``<c>_i`` (running count including this row) and ``<c>_n`` (total) for each counter.

    An existing ``_blk`` column (the same division) is used as it is.
    ``counters`` maps a name to a boolean (counted) or integer (summed) column. The first order column is an
    integer that is unique per key, or ``block`` maps rows to ascending blocks of bounded size.
    """
    keys = list(keys)
    names = list(counters)
    if "_blk" not in df.columns:
        df = df.withColumn("_blk", block if block is not None else F.floor(F.col(order[0]) / width))
    d = df.select("*", *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"_v_{n}") for n, c in counters.items()])
    sizes = d.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    offsets = prefix_sums(sizes, keys, names)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(BEFORE, 0)
    # window first: its sort by (key, block, order) also serves the merge join with the block offsets
    local = d.select(*d.columns, *[F.sum(f"_v_{n}").over(w).alias(f"_r_{n}") for n in names])
    return local.join(offsets.hint("merge"), [*keys, "_blk"]).select(
        *[c for c in df.columns if c != "_blk"],
        *[(F.col(f"{n}_before") + F.col(f"_r_{n}")).alias(f"{n}_i") for n in names],
        *[F.col(f"{n}_n") for n in names],
    )


def row_blocks(df: DataFrame, before: int, after: int, index: str = "row_i", size: int = 4096) -> DataFrame:
    """Assign rows to blocks ``_rb`` of ``size`` positions, copying edge rows to the neighbour.

    ``_own`` marks the row in its home block; keep only those after the windows are evaluated.
    """
    if max(before, after) > size:
        raise ValueError("halo larger than a block")
    home = F.floor((F.col(index) - 1) / size)
    pos = (F.col(index) - 1) % size
    targets = [home]
    if after:
        targets.append(F.when((pos < after) & (home > 0), home - 1))
    if before:
        targets.append(F.when(pos >= size - before, home + 1))
    return df.select(
        "*", home.alias("_home"),
        F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())).alias("_rb"),
    ).withColumn("_own", F.col("_home") == F.col("_rb")).drop("_home")


def block_window(index: str = "row_i", keys: Sequence[str] = PLAYER) -> Window:
    return Window.partitionBy(*keys, "_rb").orderBy(index)


def consecutive_runs(df: DataFrame, seq: str, keys: Sequence[str] = PLAYER, aggs: Sequence[Column] = (),
                     width: int = BLOCK) -> DataFrame:
    """Maximal runs of rows whose integer ``seq`` (unique per key) rises by one.

    Output: keys, run_start, run_end, run_len and ``aggs``.
    """
    idx = block_index(df, {"run": F.lit(1)}, keys, (seq,), width)
    return idx.groupBy(*keys, (F.col(seq) - F.col("run_i")).alias("_run")).agg(
        F.min(seq).alias("run_start"), F.max(seq).alias("run_end"), F.count(F.lit(1)).alias("run_len"), *aggs
    ).drop("_run")


def exact_percentile(df: DataFrame, value: str, p: float, out: str, keys: Sequence[str] = PLAYER,
                     widths: Sequence[float] = ()) -> DataFrame:
    """Linear-interpolated percentile per key.

    Equal values are counted first, before any shuffle, so a value that fills a third of the rows is one row after
    that. Each round counts in buckets, finds the bucket(s) that hold the two wanted ranks and keeps only the values in them. The first
    buckets are logarithmic, 512 per factor e beyond 1/64, so that doubles of any size fall into some hundred thousand at
    most and none holds all that is large; ``widths`` adds rounds of equal buckets inside those.
    """
    keys = list(keys)
    x = F.col(value).cast("double").alias("_x")
    rows = df.select(*keys, x).where("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.withColumns({"_below": F.lit(0).cast("long"), "_lo": F.lit(None).cast("long"),
                             "_hi": F.lit(None).cast("long"), "_frac": F.lit(None).cast("double"), "_base": F.lit(0.0)})
    state = ("_below", "_lo", "_hi", "_frac", "_base")
    grp: list[str] = []
    for level, width in enumerate((None, *widths)):
        b = f"_b{level}"
        if level == 0:
            offset = F.signum("_x") * F.log1p(F.abs("_x") * 64.0) * 512.0
        else:
            offset = F.least(F.greatest((F.col("_x") - F.col("_base")) / width, F.lit(-1e6)), F.lit(1e6))
        rows = rows.withColumn(b, F.floor(offset))
        part = [*keys, *grp]
        w = Window.partitionBy(*part).orderBy(b).rowsBetween(BEFORE, 0)
        hist = rows.groupBy(*part, b).agg(F.sum("_c").alias("_c"), *[F.first(c).alias(c) for c in state])
        if level == 0:
            hist = hist.withColumn("_pos", F.lit(float(p)) * (F.sum("_c").over(Window.partitionBy(*part)) - 1))
            hist = hist.withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos"), "_frac": F.col("_pos") - F.floor("_pos")})
        picks = hist.withColumn("_cum", F.col("_below") + F.sum("_c").over(w)).where("_cum > _lo and _cum - _c <= _hi").select(
            *part, b, (F.col("_cum") - F.col("_c")).alias("_below"), "_lo", "_hi", "_frac",
            ((F.signum(b) * F.expm1(F.abs(b) / 512.0) / 64.0) if level == 0 else F.col("_base") + F.col(b) * width).alias("_base"))
        grp.append(b)
        rows = rows.drop(*state).join(picks, [*keys, *grp])
    w = Window.partitionBy(*keys, *grp).orderBy("_x").rowsBetween(BEFORE, 0)
    ranked = rows.withColumn("_cum", F.col("_below") + F.sum("_c").over(w))
    lo = F.min(F.when(F.col("_cum") > F.col("_lo"), F.col("_x")))
    hi = F.min(F.when(F.col("_cum") > F.col("_hi"), F.col("_x")))
    return ranked.groupBy(*keys).agg((lo + (hi - lo) * F.first("_frac")).alias(out))
