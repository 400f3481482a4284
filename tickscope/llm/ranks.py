"""Gapless numbers inside groups that may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of the numbering holds on average at most.
ROWS_AT_ONCE = 200_000


def numbered(df: DataFrame, group: str, order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... inside each ``group``, in no promised order.

    Rows of a group are dealt into buckets by a hash of ``order``, numbered per bucket, and the buckets' counts are added up in
    front. ``rows`` is the number of rows of ``df``; ``order`` should tell rows apart, equal rows share a bucket.
    """
    buckets = max(16, -(-rows // ROWS_AT_ONCE))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(5)), F.lit(buckets)))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_bucket", (F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(before, [group, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_before"))
