import pytest

import corpus_pipeline
from gleanwork.llm import secret_scan
from tests.llm.brute import brute_components, shingles


def test_stages(spark, tmp_path):
    """Each stage against a plain one on what its predecessor kept."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert len(after) > 0.8 * len(before)
        elif name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t or ""] = max(i, last.get(t or "", i))
            assert set(after) == set(last.values())
        elif name == "near_dedup":
            reached = brute_components({i: shingles(t, 5) for i, t in before.items()})
            assert set(after) == {i for i, c in reached.items() if i == c}
        elif name == "secrets":
            assert set(after) == set(before)
            assert all(secret_scan.MARK in after[i] for i in after if after[i] != before[i])
        before = after
    assert {r.doc_id for r in docs.collect()} == set(before)


def test_odd_documents(spark, odd_table, tmp_path):
    docs = odd_table.drop("row", "chunk")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= {0, 1, 2, 3, 4, 5, 6, 7, None}


@pytest.mark.parametrize("labels", [[(0, 0)], []])
def test_odd_documents_pass_without_both_classes(spark, odd_table, tmp_path, labels):
    """Nothing is learned, so the first stage keeps all rows and the others decide."""
    odd_table.drop("row", "chunk").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.remove_toxic(spark, docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    if labels:
        rows = [(r.doc_id, r.start) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
        assert {i for i, _ in rows} == {2, 3, 4, 5, 6, 7}
        assert len(set(rows)) == len(rows)
        assert all(sum(i == j for j, _ in rows) == 1 for i in (2, 3, 4, 6, 7))
