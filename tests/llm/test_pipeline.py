"""The pipeline's stages over odd documents and an empty table, and its plain doubles."""

import pytest
from conftest import doc

import corpus_pipeline
from repolith.llm import near_dedup, simhash


@pytest.fixture(scope="module")
def folder(spark, make_docs, odd_docs, tmp_path_factory):
    """Odd documents with labels: texts with one offence are toxic."""
    path = tmp_path_factory.mktemp("sf")
    rows = odd_docs + [doc(2000 + k, f"quiet words number {k} about gardens rivers and bread " + ("you filthy vermin" if k % 2 else "with some salt")) for k in range(160)]
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(2000 + k, k % 2, k % 2) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_keeps_columns_and_decides(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k == 0:
            gone = set(ids(before)) - set(ids(docs))
            assert gone >= {2000 + k for k in range(1, 160, 2)} and not gone & {2000 + k for k in range(0, 160, 2)}
        if k == 1:
            texts = [(r.text or "").lower() for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if k == 2:
            assert docs.count() == near_dedup.mark_near_duplicates(before).select("component").distinct().count()
        if k == 3:
            assert docs.count() and set(ids(docs)) <= set(ids(before))
    out = corpus_pipeline.encode(spark, docs, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()


def test_run_is_the_stages_and_reruns_agree(spark, folder):
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) for _ in range(2))
    assert first and first == second


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, near_dedup.drop_near_duplicates])
def test_repeated_identifiers_lose_no_text(spark, make_docs, drop):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "quite another text about the sea and its salt", "a third text that has nothing to do with them")
    docs = make_docs([doc(5, a), doc(5, b), doc(7, c), doc(7, c), doc(None, "no identifier here at all"), doc(None, "no identifier here at all")])
    assert sorted((r.doc_id or 0, r.text) for r in drop(docs).collect()) == sorted([(5, a), (5, b), (7, c), (0, "no identifier here at all")])
