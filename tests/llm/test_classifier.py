from pathlib import Path

import numpy as np
import pytest
from conftest import SF, sentence

from changelens.llm import classifier as cl
from changelens.llm import queries


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(held) > 20 and np.mean([a == b for a, b in held]) >= 0.95


def test_scores_equal_densities_computed_one_by_one(spark, documents):
    good = [(i, sentence(i, 60 + i), "a") for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! " * (9 + i), "a") for i in range(40)]
    docs = documents(good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in good + bad], "doc_id long, quality int")
    model = cl.train(cl.with_statistics(docs), labels)
    got = {r["doc_id"]: r for r in cl.score_documents(docs, labels).collect()}
    x = {i: cl.statistics(t) for i, t, _ in good + bad}
    seen = [i for i in x if not got[i]["held_out"]]
    n = np.array([sum(i >= 100 for i in seen), sum(i < 100 for i in seen)])
    for i in x:
        logs = []
        for k in (0, 1):
            root = np.linalg.inv(model.whiten[k])
            cov = root @ root.T
            d = x[i] - model.means[k]
            logs.append(np.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    assert np.mean([got[i]["predicted"] == int(i < 100) for i in x]) > 0.95


def test_held_out_labels_do_not_matter(spark, documents):
    docs = documents([(i, sentence(i) if i % 2 else "AAA!! " * (5 + i), "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) quality")
    a, b = ({r["doc_id"]: r["score"] for r in cl.score_documents(docs, t).collect()} for t in (labels, flipped))
    assert a == pytest.approx(b)


def test_messy_rows_single_class_and_no_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = cl.score_documents(messy, none).collect()
    assert len(rows) == messy.count() and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    assert {r["score"] for r in cl.score_documents(messy, one).collect()} == {1.0}
    assert cl.score_documents(empty, one).collect() == []
    kept = cl.accepted_documents(messy, one)
    assert kept.columns == messy.columns and kept.count() == messy.count()
