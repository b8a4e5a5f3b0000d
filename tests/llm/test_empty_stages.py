"""Every stage of the pipeline, and operators beside it, on tables without rows or without texts."""

import pytest

import corpus_pipeline
from undertow.llm import pii, quality, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a question about words and other words, long enough to be found again")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]], ids=["no rows", "no texts"])
def test_stages(spark, tables, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        # Repeated rows are one document to the stage that removes duplicates.
        kept = docs.distinct() if name == "near_duplicates" else docs
        assert sorted(map(repr, out.collect())) == sorted(map(repr, kept.collect())), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert mixed.count() == len(rows)


def test_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    some = spark.createDataFrame([(1, "some words here", "en", "a", 15), (1, "some words here", "en", "a", 15)], DOCS)
    for out in (pii.span_digest(docs), quality.quality_rules(docs, labels), toxicity.toxicity(docs, labels), url_filter.filter_urls(pages)):
        assert out.isEmpty()
    assert [r["score"] for r in toxicity.toxicity(some, labels).collect()] in ([x, x] for x in [toxicity.toxicity(some.limit(1), labels).first()["score"]])
    assert quality.quality_rules(some, labels).filter("base_failed and not kept").count() == 2
