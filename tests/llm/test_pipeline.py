"""The pipeline: each stage works on what the one before kept."""
import corpus_pipeline
from tessera.llm import decontaminate, line_dedup, minhash_forest
from tests.llm.test_dedup import brute_near, words_of


def test_stages_take_effect(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        from tessera.llm.common import Scratch
        kept.append(Scratch(spark, "t").write(stage(spark, kept[-1], sf_tiny), name))
    for df in kept[1:-1]:
        assert df.columns == columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert ids[0] > ids[1] and ids[1] == ids[2] and ids[2] >= ids[3] and ids[3] >= ids[4] and ids[4] == ids[5]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_tiny}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_tiny}/labels.parquet").where("quality = 1").collect()}
    assert len(ids[1] & bad) <= 0.1 * len(bad) and len(good - ids[1]) <= 0.05 * len(good)
    assert all(r.line_stats.n_dropped == 0 for r in line_dedup.line_dedup(spark, kept[2]).collect())
    assert all(r.kept for r in minhash_forest.near_duplicates(spark, kept[3]).collect())
    bench = spark.read.parquet(f"{sf_tiny}/benchmark.parquet")
    assert decontaminate.find_leaks(spark, kept[4], bench).where("size(leaks) > 0").count() == 0


def test_stages_on_an_empty_table(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_tiny)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_tiny).count() == 0


def test_near_copies_from_four_fifths_on_are_dropped(spark, sf_tiny):
    docs = []
    for n in range(24):  # pairs that differ in a run of n words
        base = words_of(100, n)
        docs += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(base[:40] + [f"new{i}" for i in range(n)] + base[40 + n:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, sf_tiny).collect())
    assert kept == sorted(i for i, _, _, stays in brute_near(docs, 80) if stays)
    assert kept != sorted(i for i, _, _, stays in brute_near(docs, 85) if stays)
