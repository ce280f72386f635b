"""The pipeline against its operators, stage by stage, and on odd tables."""

from __future__ import annotations

import os

from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm.common import work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, docs, sf_dir):
    folder = work(spark)
    made = []
    for name, stage in corpus_pipeline.STAGES:
        docs = folder.write(stage(spark, docs, sf_dir), name)
        made.append(docs)
    return made


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(os.path.join(SF_DIR, "documents.parquet"))
    language, copies, secrets, mixture, packed = staged(spark, docs, SF_DIR)
    for stage in (language, copies, secrets, mixture):
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    letters = {r[0] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r[0] for r in language.collect()} == letters
    texts = {}
    for r in language.collect():
        texts.setdefault(r["text"], set()).add(r["doc_id"])
    kept = {r["doc_id"] for r in copies.collect()}
    for same in texts.values():
        assert len(kept & same) <= 1
    assert kept <= letters and len(kept) >= 0.85 * len(texts)
    assert {r["doc_id"] for r in secrets.collect()} == kept
    assert secrets.filter(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).count() == 0
    assert {r["doc_id"] for r in mixture.collect()} <= kept
    most = mixture.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most == 2
    rows = packed.select("doc_id", "piece").distinct()
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in mixture.collect()}
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= corpus_pipeline.CAPACITY


def test_odd_rows_and_no_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5),
        (4, "same words here", "en", None, 15), (4, "same words here", "en", None, 15),
        (None, "no id at all", None, "b", 12), (5, "x" * 50_000, "en", "b", 50_000),
    ]
    made = staged(spark, spark.createDataFrame(rows, SCHEMA), SF_DIR)
    assert sorted(str(r["doc_id"]) for r in made[0].collect()) == ["4", "4", "5", "None"]
    assert made[-1].count() > 0
    assert staged(spark, spark.createDataFrame([], SCHEMA), SF_DIR)[-1].count() == 0
