"""Training corpus from documents: language, repeated lines, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's rows as Parquet to the shared folder
and reads them again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickscope.llm import decontaminate, language_id, line_dedup, packing, simhash  # noqa: E402
from tickscope.sources.workdir import materialize  # noqa: E402

#: A text is rejected as no language when it has this many trigrams and is less similar than this to every prototype: three standard
#: deviations of the cosine of unrelated vectors with 1,024 dimensions.
ENOUGH_TRIGRAMS = 50
LEAST_SCORE = 0.1


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; texts without a letter and long ones unlike every language go."""
    names, prototypes = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))), "text", "lang")
    judged = language_id.predict(docs, "text", names, prototypes)
    unlike = (F.col("n_trigrams") >= ENOUGH_TRIGRAMS) & (F.col("score") < LEAST_SCORE)
    return judged.where((F.col("lang_pred") != "und") & ~unlike).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand in ten or more; ``n_chars`` follows the text, other columns stay."""
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return line_dedup.without_repeated_lines(docs).select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id stay, rows that repeat an id go or
    stay together."""
    found = simhash.near_duplicates(docs)
    others = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as pieces of token sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages), ("line_dedup", repeated_lines), ("simhash", near_duplicates), ("decontamination", benchmark_passages),
    ("packing", pack)]

#: Hyperdimensional profiles, XXH64 fingerprints and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
