"""The pipeline on the smallest tables: each stage against brute force on its own input."""

from test_texts import brute_lines, edits
from test_tokens_and_packing import check_packing, plain  # noqa: F401
from test_vectors_and_prints import brute_fingerprint, smallest

from pyspark.sql import functions as F

import corpus_pipeline
from tickscope.llm import decontaminate
from tickscope.sources.workdir import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark, plain):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect())
        assert docs.columns == columns or name == "packing"
    before, after = seen["language_id"]
    assert len(after) >= 0.95 * len(before)
    before, after = seen["line_dedup"]
    ids = list(before)
    want = brute_lines([before[i].text for i in ids], 10)
    assert {r.doc_id: r.text for r in after} == {i: want[k][2] for k, i in enumerate(ids)}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["simhash"]
    fps = {i: brute_fingerprint(r.text) for i, r in before.items()}
    label = smallest(fps, [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r.doc_id for r in after} == {i for i in fps if label[i] == i}
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in before.items() if any(t in r.text for t in items)}
    gone = set(before) - {r.doc_id for r in after}
    assert whole <= gone
    passages = [p.tolist() for t in items for p in decontaminate.passages_of(t)]
    for i in sorted(gone)[:3]:
        c = decontaminate.normalized(before[i].text).tolist()
        assert any(edits(p, c) <= decontaminate.edit_budget(len(p)) for p in passages)
    before, after = seen["packing"]
    check_packing(after, {i: r.text for i, r in before.items()}, plain)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.columns[:4] == ["doc_id", "piece", "start", "length"]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns with names of results; and no rows at all."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(None, "words of no id at all", None, None, None), (9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34", "en", None, 5),
            (9003, "said twice in full here", "en", "s", 5), (9003, "said twice in full here", "en", "s", 5)]
    docs = real.union(spark.createDataFrame(rows, real.schema)).withColumn("score", real.sparkSession.range(1).select().count() * F.lit("x"))
    for kept in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, columns = kept.count(), kept.columns
            kept = materialize(stage(spark, kept, SF), f"odd_{name}")
            assert name == "packing" or (kept.columns == columns and kept.count() <= before)
        assert (kept.count() > 0) == (before > 0)
