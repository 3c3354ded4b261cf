"""Columns of any names pass through what returns documents, with their own values."""

import pytest

import corpus_pipeline
from gleanwork.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from tests.llm.test_tokens import WORDS

OPERATORS = {
    "exact": (exact_dedup.deduplicate, {2, 3, 4, 5, 6, 7}),
    "near": (near_dedup.deduplicate, {0, 1, 2, 3, 5, 6, 7}),
    "secrets": (secret_scan.without_secrets, {0, 1, 2, 3, 4, 5, 6, 7, None}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_keep_their_columns(clashing, name):
    operator, ids = OPERATORS[name]
    before = {}
    for r in clashing.collect():
        before.setdefault(r.doc_id, r.asDict())
    found = operator(clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert {r.doc_id for r in rows} == ids
    for r in rows:
        was, now = dict(before[r.doc_id]), r.asDict()
        if name == "secrets" and r.doc_id == 7:
            assert secret_scan.MARK in now["text"]
            was["text"] = now["text"]
        assert now == was
    empty = operator(clashing.limit(0))
    assert empty.columns == clashing.columns and empty.collect() == []


def test_pipeline_keeps_them_too(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == clashing.columns
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}


def test_a_row_repeated_for_a_third_of_the_table_is_dealt_evenly(spark, tmp_path):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, 'same words here', concat('word ', id)) as text")
    cut = packing.cut(docs, WORDS, 2048, 1)
    cut.write.parquet(f"{tmp_path}/pieces")
    groups = 6
    found = packing.pack(spark.read.parquet(f"{tmp_path}/pieces"), groups, 2048, 8).collect()
    sizes = [sum(r.sequence_id % groups == g for r in found) for g in range(groups)]
    assert sum(sizes) == 3000 and max(sizes) < 650


def test_one_text_is_learned_from_an_id(spark):
    rows = [(i % 4, f"clean words of text {i}" if i % 2 else f"nasty toxic words {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(4)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    toxicity.fit = lambda bags, toxic, *rest: seen.append((len(bags), toxic)) or fit(bags, toxic, *rest)
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.fit = fit
    assert seen == [(4, [1, 0, 1, 0])]
