"""Joins on keys of which one may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(rows: DataFrame, verdicts: DataFrame, key: str, spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``verdicts``, one row per ``key`` and few columns: rows of a key are dealt by a hash of ``spread`` into ``salts``
    groups, and its verdict goes to each of them."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    each = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(each, [key, "_salt"], how).drop("_salt")
