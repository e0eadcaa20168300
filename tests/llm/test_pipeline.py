import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from postwright.llm import mixing, ngram_join, quality_rules
from tests.llm.test_corpus_operators import brute_components


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_take_effect(spark, sf_dir, docs, tmp_path):
    kept = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        if name == "quality_rules":
            good = quality_rules.quality_rules(kept).where("kept").select("doc_id")
            assert sorted(r[0] for r in good.collect()) == sorted(r["doc_id"] for r in after.select("doc_id").collect())
        elif name == "line_dedup":
            assert after.count() == kept.count() and after.where("n_chars <> char_length(text)").count() == 0
        elif name == "ngram_jaccard_join":
            want = {k for k, (_, c) in brute_components({r["doc_id"]: r["text"] for r in kept.collect()}, 5, 8, 10).items() if k == c}
            assert {r["doc_id"] for r in after.collect()} == want
        elif name == "mixing":
            share = after.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] / kept.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
            assert 0.6 < share < 0.95
        else:
            assert after.agg(F.sum("n_tokens")).first()[0] == kept.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
        kept = after
    assert pipeline.run(spark, sf_dir).count() == kept.count()


def test_keep_first_leaves_one_of_each_group(spark):
    long = " ".join(f"w{k}" for k in range(80))
    d = spark.createDataFrame([(3, long), (1, long + " x"), (2, "other text"), (None, long), (7, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_first(d).collect()) == ["1", "2", "7", "None"]
