from pathlib import Path

import pytest
from check_oracle import difference, duck
from conftest import SF

from changelens.llm import mixing, oracle, queries


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_equals_sql(spark):
    got = queries.op9_mixing(spark, SF).toPandas()
    assert difference(got, duck(SF).sql(oracle.OP9_MIXING).df()) == ""


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a stops at 30; null would get 360 of the rest and stops at 300; b takes what remains.
    assert got == {"a": pytest.approx(30.0), "b": pytest.approx(780.0), None: pytest.approx(300.0)}


def test_taken_words_come_near_the_target(spark, documents):
    docs = documents([(i, "w " * (1 + i % 40), ("x", "y", "z")[i % 3]) for i in range(3000)])
    rows = mixing.mixture(docs).collect()
    for source in "xyz":
        mine = [r for r in rows if r["source"] == source]
        part = mine[0]["target"] / mine[0]["source_size"] % 1
        spread = (part * (1 - part) * sum(r["size"] ** 2 for r in mine)) ** 0.5
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4 * spread
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_repeats_agree_with_the_mixture_and_keep_columns(messy):
    counts = {}
    for r in mixing.mixture(messy).collect():
        counts[r["doc_id"], r["source"], r["size"]] = r["copies"]
    out = mixing.repeat_documents(messy)
    assert out.columns == messy.columns
    got = {}
    for r in out.collect():
        k = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[k] = got.get(k, 0) + 1
    repeated = (1, "a", 40)
    assert got[repeated] == 2 * counts[repeated]
    assert {k: v for k, v in got.items() if k != repeated} == {
        k: v for k, v in counts.items() if v and k != repeated
    }


def test_empty_and_wordless_tables(empty, documents):
    assert mixing.mixture(empty).collect() == []
    rows = mixing.mixture(documents([(1, None, "a"), (2, "  ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
