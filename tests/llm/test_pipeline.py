"""The pipeline's stages on a small table, awkward rows included, and its last rows."""

from __future__ import annotations

import corpus_pipeline
from lumenfold.llm.queries import QUERIES


def test_stages_keep_columns_and_clean_documents(spark, workdir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "1234 !!", "en", "s", 7), (None, docs.first().text, "en", "s", 1)],
        docs.schema,
    )
    columns, before = docs.columns, None
    docs = docs.union(more).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{workdir}/{name}")
        docs = spark.read.parquet(f"{workdir}/{name}")
        if name != "byte_bpe":
            assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "language_id":
            assert not {9001, 9002, 9003} & set(ids)
        if name == "near_duplicates":
            assert None not in ids and len(ids) == len(set(ids))
        if before is not None:
            assert len(ids) <= before
        before = len(ids)
    assert before > 150


def test_empty_table_passes(spark, workdir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
