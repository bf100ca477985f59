"""The pipeline stage by stage, each against brute force on what the stage before it kept."""

from __future__ import annotations

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from cellpath.llm import quality, queries
from cellpath.llm.staged import stage


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    outputs = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), "test")
        outputs.append(docs)
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in outputs[:4]]
    assert all(d.columns == columns for d in outputs[:4])

    judged = {r.doc_id: r.kept for r in quality.assess(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")).collect()}
    assert set(texts[0]) == {k for k, kept in judged.items() if kept}
    assert set(texts[1]) == {d for d, _, c, kept in brute.near_duplicates(list(texts[0].items())) if kept}
    assert set(texts[2]) == {r[0] for r in brute.contamination(list(texts[1].items()), items) if not r[5]}
    assert set(texts[3]) == set(texts[2])
    assert all(sum(r[1:5]) == 0 for r in brute.personal_data(list(texts[3].items())))
    clean = [d for d, *found in brute.personal_data(list(texts[2].items())) if not sum(found[:4])]
    assert sum(texts[3][d] == texts[2][d] for d in clean) >= 0.98 * len(clean)
    assert {r.doc_id for r in outputs[4].collect()} == set(texts[3])


def test_repeated_and_null_rows(spark, sf_dir):
    docs = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (3, None, "en", "s", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for _, function in corpus_pipeline.STAGES[:-1]:
        df = stage(function(spark, df, sf_dir), "test")
    assert sorted((r.doc_id for r in df.collect()), key=str) == [1, 3, None]
    assert df.columns[-1] == "extra"
