from pathlib import Path

import pytest
from conftest import SF
from test_ngram_join import brute
from test_pii import base

import corpus_pipeline
from changelens.llm import queries

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    good = stages[0](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert good.columns == columns
    judged = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(judged) / len(judged) >= 0.97

    single = stages[1](spark, good, SF).cache()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    heads = {c for _, _, c in brute(rows, 5, 80, 100)}
    assert {r["doc_id"] for r in single.collect()} == heads and single.columns == columns

    clean = stages[2](spark, single, SF).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert base(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert clean.columns == columns and clean.count() == single.count()

    mixed = stages[3](spark, clean, SF)
    assert mixed.columns == columns
    ids = stages[4](spark, mixed, SF)
    assert ids.count() == mixed.count()


def test_run_and_registered_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_run_on_messy_and_empty_tables(spark, messy, empty, documents, tmp_path):
    good = [(r["doc_id"] + 1000, r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 1000 doc_id", "quality", "toxic")
    for name, docs in (("messy", messy.union(documents(good))), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "ids"]
        assert (out.count() > 0) == (name == "messy")


@pytest.mark.parametrize("name", [name for name in queries.queries() if not name.startswith("op13")])
def test_every_query_gives_a_row_per_input_row(spark, name):
    table = {"op2": "embeddings", "op4": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
