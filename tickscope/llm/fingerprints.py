"""Document fingerprints by consistent weighted sampling: native DataFrame operations only.

A document is a bag of terms (words in lower case, or shingles of ``words`` of them) with their counts as weights w. Each of ``samples`` functions
draws for a term r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of the term, takes t = floor(ln w / r + b) and
a = c exp(-r (t - b + 1)); the term with the least a and its t are the sample. Two bags agree in a sample with the probability of their
generalised Jaccard similarity, the sum of the lesser over the sum of the greater weights. A sample is kept as 24 bits of (term, t), so two
different ones agree by chance once in 16 million.

Terms are counted inside the row of their document (sorted hashes, lengths of runs), so that only rows of one term are ever made and the least
values are aggregated without another exchange: the one exchange deals documents by blocks of the order of ids, in which each document also
meets its successor.

Defined cases: a null text is empty; a text with fewer words than a shingle is one term, and so is an empty text, hence two empty texts are
alike in full. Rows are in descending order of ids, null ids last, equal ids by a hash of the text; rows equal in both are
each other's successors. A table of one row follows itself. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickscope.sources.workdir import materialize

SAMPLES = 64
#: Bits of a kept sample, and of the fixed-point number a in front of it (cut at 64, far above any least value).
CODE_BITS, FIXED = 24, 32
#: The least a of a bag of weight W is exponential with rate W: above CERTAIN / W once in 1e13 samples, which then is 0.
CERTAIN = 30.0
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text and number of blocks of documents that are sorted together: at least as many as shuffle partitions.
BLOCK_BYTES, MOST_BLOCKS = 64 << 20, 1 << 15


def term_hashes(text: Column, words: int) -> Column:
    """64-bit hashes of all terms, repeats included; never empty."""
    each = F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), SPACE)
    if words == 1:
        return F.transform(each, lambda w: F.xxhash64(w))
    first = F.sequence(F.lit(1), F.greatest(F.size(each) - (words - 1), F.lit(1)))
    return F.transform(first, lambda i: F.xxhash64(F.array_join(F.slice(each, i, words), " ")))


def _part(h: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)


def _draws(term: Column, d: Column) -> tuple[Column, Column, Column]:
    """q and x, products of two uniform numbers (c = -ln q, r = -ln x), and b."""
    h, g = F.xxhash64(term, d * 2), F.xxhash64(term, d * 2 + 1)
    return (_part(h, 32, 32) * _part(h, 0, 32) * F.lit(2.0 ** -64), _part(g, 43, 21) * _part(g, 22, 21) * F.lit(2.0 ** -42),
            _part(g, 0, 22) * F.lit(2.0 ** -22))


def possible(term: Column, weight: Column, most: Column, d: Column) -> Column:
    """False only where a is above ``most``: a is at least 2 (1 - q) / (1 + q) times x / (x + s (1 - x)) / w, where s = 1 - b for w = 1 and 1 otherwise.
    Most terms are done with here, without a logarithm. A filter evaluates what it names twice twice, so q, x and b stand once."""
    q, x, b = _draws(term, d)
    one = F.lit(1.0)
    s = F.when(weight == 1, one - b).otherwise(one)
    return F.lit(4.0) / (one + q) - F.lit(2.0) <= most * weight * (one + s * (one / x - one))


def sample(term: Column, weight: Column, d: Column) -> Column:
    """Function ``d`` of a term as one long: a in fixed point, then the bits of (term, t). The least one is the bag's sample."""
    q, x, b = _draws(term, d)
    r = -F.ln(x)
    t = F.floor(F.ln(weight) / r + b)
    a = F.least(-F.ln(q) * F.exp(r * (b - t - F.lit(1.0))), F.lit(64.0 - 2.0 ** -20))
    code = term.bitwiseXOR(F.shiftright(term, CODE_BITS)).bitwiseXOR(t * F.lit(0x9E3779)).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    return F.shiftleft((a * F.lit(2.0 ** FIXED)).cast("long"), CODE_BITS).bitwiseOR(code)


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", words: int = 1, samples: int = SAMPLES, carried: list[str] = ()) -> DataFrame:
    """``keys``, ``carried`` and ``codes``, the bag's samples (array of ``samples`` longs). Rows equal in ``keys`` count as one bag; ``carried``
    columns, whole numbers or booleans, depend on them.

    If ``docs`` is already dealt by some of ``keys``, nothing is exchanged.
    """
    sorted_ = docs.select(*keys, *carried, F.sort_array(term_hashes(F.coalesce(F.col(text_col), F.lit("")), words)).alias("_s"))
    runs = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    # the outer form adds no filter that would count the terms again; there is at least one
    terms = sorted_.withColumn("_runs", runs).select(*keys, *carried, "_s", "_runs", F.posexplode_outer("_runs").alias("_j", "_at")).select(
        *keys, *carried, "_j", F.get("_s", F.col("_at")).alias("_term"), (F.lit(CERTAIN) / F.size("_s")).alias("_most"),
        (F.coalesce(F.get("_runs", F.col("_j") + 1), F.size("_s")) - F.col("_at")).cast("double").alias("_w"))
    # carried columns go along as further functions of the first term, so that the aggregation of all others holds one number
    first, every = F.sequence(F.lit(0), F.lit(samples + len(carried) - 1)), F.sequence(F.lit(0), F.lit(samples - 1))
    each = terms.withColumn("_d", F.explode_outer(F.when(F.col("_j") == 0, first).otherwise(every))).where(
        (F.col("_d") >= samples) | possible(F.col("_term"), F.col("_w"), F.col("_most"), F.col("_d")))
    # joined by bits: inside a branch, common parts of the sample would be evaluated again
    drawn = sample(F.col("_term"), F.col("_w"), F.col("_d")).bitwiseAND(F.when(F.col("_d") < samples, F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    if carried:
        at = [(F.col("_d") == samples + i, F.col(c).cast("long")) for i, c in enumerate(carried)]
        drawn = drawn.bitwiseOR(reduce(lambda when, case: when.when(*case), at[1:], F.when(*at[0])).otherwise(F.lit(0).cast("long")))
    least = each.groupBy(*keys, "_d").agg(F.min(drawn).alias("_m"))
    code = F.struct("_d", F.when(F.col("_d") < samples, F.col("_m").bitwiseAND(F.lit((1 << CODE_BITS) - 1))).otherwise(F.col("_m")).alias("code"))
    found = least.groupBy(*keys).agg(F.sort_array(F.collect_list(code)).alias("_all")).withColumn("_c", F.filter("_all", lambda x: x["_d"] < samples))
    filled = F.transform(every, lambda d: F.coalesce(F.get(F.filter("_c", lambda x: x["_d"] == d), F.lit(0))["code"], F.lit(0)))
    types = dict(docs.dtypes)
    back = [F.get("_all", F.size("_c") + i)["code"].cast(types[c]).alias(c) for i, c in enumerate(carried)]
    return found.select(*keys, *back, F.when(F.size("_c") == samples, F.col("_c.code")).otherwise(filled).alias("codes"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def as_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), CODE_BITS // 4, "0")), "")


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_block, _own, _id, _order, _text): documents dealt by blocks of their order, the first of each block also at the end of the block before
    it (``_own`` false; before the first block comes the last).

    The bounds of the blocks are the first rows of a range partitioning of (id, hash); each document finds its block among them by bisection.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    order = F.struct(F.col("_id").isNull().alias("nul"), F.coalesce(F.bitwise_not(F.col("_id").cast("long")), F.lit(0).cast("long")).alias("inv"),
                     F.xxhash64("_text").alias("mark"))
    spark = docs.sparkSession
    narrow = materialize(rows.select(order.alias("_order"), F.octet_length("_text").cast("long").alias("_bytes")), "order")
    size = narrow.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    blocks = min(MOST_BLOCKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES)))
    firsts = narrow.repartitionByRange(blocks, "_order").groupBy(F.spark_partition_id().alias("p")).agg(F.min("_order").alias("first"))
    bounds = [r["first"] for r in firsts.select("first").orderBy("first").collect()]  # MOST_BLOCKS at most
    listed = "[" + ",".join(f'{{"nul":{str(b["nul"]).lower()},"inv":{b["inv"]},"mark":{b["mark"]}}}' for b in bounds) + "]"
    every = F.from_json(F.lit(listed), "array<struct<nul:boolean,inv:bigint,mark:bigint>>")
    n = max(len(bounds), 1)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    block = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < n) & (F.get(every, at + s) <= F.col("_order")), at + s).otherwise(at))
    placed = rows.withColumn("_order", order).withColumn("_block", block)
    own = F.struct(F.col("_block").alias("block"), F.lit(True).alias("own"))
    copy = F.struct(F.pmod(F.col("_block") - 1, F.lit(n)).alias("block"), F.lit(False).alias("own"))
    places = F.when(F.get(every, F.col("_block")) == F.col("_order"), F.array(own, copy)).otherwise(F.array(own))
    return placed.select("_id", "_order", "_text", F.explode_outer(places).alias("_p")).select(
        F.col("_p.block").alias("_block"), F.col("_p.own").alias("_own"), "_id", "_order", "_text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1, samples: int = SAMPLES) -> DataFrame:
    """Per row its id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``: how its fingerprint
    bears a change of the second half of the text (its last floor(n/2) code points become the first of the next document), and how like
    the next document is.
    """
    inside = Window.partitionBy("_block").orderBy(F.desc("_own"), "_order")
    lined = in_blocks(docs, id_col, text_col).withColumns({"_next": F.lead("_text").over(inside), "_no": F.row_number().over(inside)})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("_next"), F.lit(1), half))
    whole = lined.withColumn("n_chars", F.char_length("_text").cast("long")).withColumn("_edited", F.coalesce(edited, F.lit("")))
    digest = whole.withColumn("_sha", F.sha2("_edited", 256))
    parts = [F.conv(F.substring("_sha", 16 * k + 1, 16), 16, -10).cast("long").alias(f"_sha{k}") for k in range(4)]
    both = digest.select("_block", "_no", "_own", "_id", "n_chars", *parts, F.posexplode_outer(F.array("_text", "_edited")).alias("_kind", "_bag"))
    found = fingerprints(both, ["_block", "_no", "_kind"], "_bag", words, samples, ["_own", "_id", "n_chars", *[f"_sha{k}" for k in range(4)]])
    after = Window.partitionBy("_block").orderBy("_no", "_kind")
    joined = found.withColumns({"_of_edited": F.lead("codes", 1).over(after), "_of_next": F.lead("codes", 2).over(after)})
    return joined.where("_own and _kind = 0").select(
        F.col("_id").alias(id_col), "n_chars", F.concat(*[F.lpad(F.lower(F.hex(f"_sha{k}")), 16, "0") for k in range(4)]).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"), as_text(F.col("_of_edited")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("_of_edited"), samples).alias("near_edited"), likeness(F.col("codes"), F.col("_of_next"), samples).alias("near_next"))
