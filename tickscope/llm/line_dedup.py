"""Repeated lines: native DataFrame operations only.

Lines become (hash, document, position) rows, range-partitioned by hash and document and sorted by hash, document and position
inside; a line that stands in a third of all documents is thereby spread over many partitions. A pass over the sorted rows
marks the first occurrence in each document; counts are added up per partition before they meet. What comes back per
document is a compressed bitmap of dropped lines (64-bit words, those without a dropped line left out), never text.

Defined cases: null and empty texts are one empty line; empty keys are never dropped; a row's identity is its id and text, so
exact repeats of a row count as one document and are all treated alike, while rows of one id with other texts are documents
of their own. A null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.llm.salted import salted_join
from tickscope.sources.workdir import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 32  # lines per bitmap word; half a long, so that no sign matters


def line_key(line: Column) -> Column:
    """Stripped of white space at both ends, A to Z in lower case, other letters as they are."""
    cut = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("_row"), text.alias("_text"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, id, mark, pos, first): range-partitioned by hash and document, in order; first in its document or not."""
    lines = _documents(docs, id_col, text_col).select("_id", "_mark", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    keyed = lines.select("_id", "_mark", "pos", line_key(F.col("line")).alias("key")).where("key <> ''")
    hashed = keyed.select(F.unhex(F.md5("key")).alias("hash"), "_id", "_mark", "pos")
    ranged = hashed.repartitionByRange("hash", "_id", "_mark").sortWithinPartitions("hash", "_id", "_mark", "pos")
    first = F.row_number().over(Window.partitionBy("hash", "_id", "_mark").orderBy("pos")) == 1
    return ranged.withColumn("first", first)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``_id, _mark, bitmap`` of documents that lose a line: words (number, bits) in order, only those with a bit.

    A key in ``min_docs`` documents or more loses all its lines, with ``keep_first`` all but its first occurrence in
    the order of ids and positions.
    """
    rows = materialize(line_rows(docs, id_col, text_col), "lines")
    place = F.struct("_id", "_mark", "pos")
    keys = rows.groupBy("hash").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.min(place).alias("origin")).where(F.col("docs") >= min_docs)
    lost = salted_join(rows, keys.select("hash", "origin"), "hash", ["_id", "_mark"])
    if keep_first:
        lost = lost.where(~place.eqNullSafe(F.col("origin")))
    words = lost.groupBy("_id", "_mark", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    return words.groupBy("_id", "_mark").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def expanded(bitmap: Column) -> Column:
    """Bitmap as text, eight hexadecimal digits a word with the gaps filled: one letter per four lines, read at any place at once."""
    filled = F.transform(bitmap, lambda w, i: F.concat(
        F.repeat(F.lit("0" * 8), w["word"] - F.when(i == 0, -1).otherwise(F.element_at(bitmap, F.greatest(i, F.lit(1)))["word"]) - 1),
        F.lpad(F.hex(w["bits"]), 8, "0")))
    return F.array_join(filled, "").cast("binary")


def _bit(digits: Column, i: Column) -> Column:
    """Bit of line i: hexadecimal digits of a word run from the highest to the lowest."""
    at = (F.floor(i / WORD) * 8 + 8 - F.floor((i % WORD) / 4)).cast("int")
    value = F.conv(F.decode(F.substring(digits, at, 1), "utf-8"), 16, 10).cast("int")
    return F.coalesce(value, F.lit(0)).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(4)]), (i % 4 + 1).cast("int"))) != 0


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``n_lines, n_dropped, kept_text``, which replace columns of these names. Other lines stay,
    joined by line breaks.
    """
    lost = dropped_lines(docs, id_col, text_col, min_docs, keep_first)
    own = _documents(docs, id_col, text_col)
    joined = own.join(lost.withColumnsRenamed({"_id": "_lost_id", "_mark": "_lost_mark"}),
                      F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_mark") == F.col("_lost_mark")), "left")
    lines = F.split("_text", "\n")
    dropped = F.aggregate("bitmap", F.lit(0), lambda n, w: n + F.bit_count(w["bits"]))
    kept = F.array_join(F.filter(lines, lambda x, i: ~_bit(F.col("_digits"), i)), "\n")
    return joined.withColumn("_digits", expanded(F.col("bitmap"))).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")], F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("bitmap").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"))
