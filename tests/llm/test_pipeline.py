"""The pipeline's stages keep the table's form and do what their operators say."""

import corpus_pipeline
from arbora.llm import decontaminate, quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "decontaminate", "mixing"]
    columns, state = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state, stage(spark, state, DATA)
        assert state.columns == columns, name
        state = state.cache()
        assert 0 < state.count() <= before.count()
        if name == "quality":
            good = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
            assert state.join(good, "doc_id").count() >= 0.95 * docs.join(good, "doc_id").count()
        if name == "decontaminate":
            assert decontaminate.find_contained(state, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, state, DATA)
    assert mixed.filter("mix_taken <= 0").count() == 0 and mixed.count() > 0


def test_null_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\ng", None, None, None), (None, None, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    state = docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        state = stage(spark, state, DATA)
    assert state.count() == 1
    assert quality.keep_good(docs.limit(0), spark.read.parquet(f"{DATA}/labels.parquet")).count() == 0
