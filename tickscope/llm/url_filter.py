"""URL filter: rules by host and path, else naive Bayes over the segmented words of host and path.

Words of a host are run together ("freecasinogames"). Each label is cut by Viterbi under a unigram model; its word
counts come from all page texts and all URL parts. Multinomial naive Bayes over host words and path words learns from the pages
that a rule decides and judges the others. Both sums are additive, so everything is computed once per distinct host and
per distinct path shape before it meets the pages.

Defined cases: a null URL or one without "://" has an empty host and path, hence no words, and gets the prior's verdict; without any
page that a rule decides the verdict is ``allow``, also on a tie. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickscope.functions.frames import one_row
from tickscope.llm.salted import salted_join
from tickscope.sources.workdir import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: A longer run of letters is never one word.
LONGEST_WORD = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return (F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does. Rules are a configuration, a short list."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def path_shape(path: Column) -> Column:
    """Lower-case words of the path; a run of digits is one word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", " 0 "), r"[^\p{L}0]+", " "))


def best_cut(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """Viterbi; an unknown run costs a tenth for each letter, so that known words win wherever they fit."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = end - start
            p = known.get((start, n))
            options.append((best[start][0] + (p if p is not None else math.log(10 / total) - n * math.log(10)), start))
        best.append(max(options))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1]:end])
        end = best[end][1]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct ``labels`` (label, letters a to z, not empty) under ``counts`` (word, n).

    Every substring of a label that may be a word is joined with the counts; a label has at most 20 times its length of them, each beside the label's number.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    labels = materialize(labels.select("label", F.monotonically_increasing_id().alias("no")), "numbered")
    # letters are single bytes here, so a piece of a label of any length is cut out at once
    at = labels.select("no", F.col("label").cast("binary").alias("bytes"), F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    ahead = at.select("no", (F.col("at") - 1).alias("start"), F.substring(F.col("bytes"), F.col("at"), F.lit(LONGEST_WORD)).cast("string").alias("ahead"))
    spots = F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda n: F.struct(n.alias("n_letters"), F.substring(F.col("ahead"), F.lit(1), n).alias("word")))
    pieces = ahead.select("no", "start", F.inline(spots))
    matched = (pieces.join(counts, "word").groupBy("no")
               .agg(F.collect_list(F.struct("start", "n_letters", F.col("n").cast("double").alias("n"))).alias("found")))
    ready = labels.join(matched, "no", "left").withColumn("total", one_row(total)["total"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = []
            for label, found, all_n in zip(pdf["label"], pdf["found"], pdf["total"]):
                all_n = max(float(all_n), 1.0)
                known = {(x["start"], x["n_letters"]): math.log(x["n"] / all_n) for x in (found if found is not None else ())}
                words.append(best_cut(label, known, all_n))
            yield pd.DataFrame({"label": pdf["label"], "words": words})

    return ready.mapInPandas(run, "label string, words array<string>")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z]+"), lambda w: F.length(w).between(2, LONGEST_WORD))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html",
               rules=RULES, smoothing: float = 1.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds`` per page."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = own.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    shaped = parts.select("page_id", "host", "path", path_shape(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("ruled"))
    sites = materialize(shaped.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("block")), "sites")
    labels = sites.select(F.explode(F.split("host", "[^a-z]+")).alias("label")).where("label <> ''").distinct()
    seen = sites.select(F.explode(F.split("shape", " ")).alias("word"), "n").where("length(word) >= 2")
    if text_col:
        text = pages.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("word"), F.lit(1).alias("n"))
        seen = seen.union(text)
    cut = materialize(segment(labels, seen.groupBy("word").agg(F.sum("n").alias("n"))), "labels")
    hosts = sites.select("host").distinct()
    host_words = materialize(hosts.select("host", F.explode(F.split("host", "[^a-z]+")).alias("label")).join(cut, "label")
                             .select("host", F.explode("words").alias("word")), "host_words")
    # counts by class: host words weigh as often as their host is seen, path words as their shape
    by_host = sites.groupBy("host").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    by_shape = sites.groupBy("shape").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    shape_words = by_shape.select("shape", F.explode(F.split("shape", " ")).alias("word")).where("word <> ''")
    features = host_words.join(by_host, "host").select(F.concat(F.lit("h:"), "word").alias("word"), "allow", "block").union(
        by_shape.select(F.explode(F.split("shape", " ")).alias("word"), "allow", "block").where("word <> ''")
        .select(F.concat(F.lit("p:"), "word"), "allow", "block"))
    model = materialize(features.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "words")
    totals = model.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"),
                       F.count("*").alias("v")).first()
    pages_of = sites.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    known = pages_of["allow"] + pages_of["block"] > 0
    prior = math.log((pages_of["block"] + smoothing) / (pages_of["allow"] + smoothing)) if known else 0.0
    ratio = F.log((F.col("block") + smoothing) / (totals["block"] + smoothing * max(totals["v"], 1))) - F.log(
        (F.col("allow") + smoothing) / (totals["allow"] + smoothing * max(totals["v"], 1)))
    odds = model.select("word", ratio.alias("odds"))
    host_odds = (host_words.select("host", F.concat(F.lit("h:"), "word").alias("word")).join(odds, "word")
                 .groupBy("host").agg(F.sum("odds").alias("host_odds")))
    shape_odds = (shape_words.select("shape", F.concat(F.lit("p:"), "word").alias("word")).join(odds, "word")
                  .groupBy("shape").agg(F.sum("odds").alias("shape_odds")))
    scored = salted_join(salted_join(shaped, host_odds, "host", ["page_id"], "left"), shape_odds, "shape", ["page_id"], "left")
    score = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("shape_odds", F.lit(0.0))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
                         F.round(score, 9).alias("block_odds"))
