import hashlib
import random
from pathlib import Path

import pytest
from check_oracle import difference, duck
from conftest import LONG, SF, sentence
from test_resampling import words

from changelens.llm import oracle, queries
from changelens.llm.decontamination import Windows, contamination, without_contaminated


def brute(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                held = windows.get(tuple(w[s : s + n]))
                if held:
                    hit |= set(range(s, s + n))
                    found |= held
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len(found - {None})
        out.append((i, len(w), len(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, rows, items, settings=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in contamination(docs, held, settings).collect()), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_equals_sql(spark):
    frame = queries.op12_decontamination(spark, SF).toPandas()
    assert difference(frame, duck(SF).sql(oracle.OP12_DECONTAMINATION).df()) == ""
    assert frame["contaminated"].any()


ITEMS = [
    (1, sentence(1)), (2, sentence(3, 14)), (2, sentence(5, 12)), (3, sentence(1, 25)), (4, "one"), (5, "Two Words"),
    (6, "only three words"), (7, ""), (8, None), (9, "..."), (None, sentence(7, 11)), (11, "an item of six words here"),
]


@pytest.mark.parametrize("settings", [Windows(), Windows(broadcast_rows=0, most_bits=12, stretch=16)])
def test_equals_plain_reading_on_messy_rows(spark, messy_rows, settings):
    rows = [(i, t) for i, t, _ in messy_rows] + [
        (30, "pre " + sentence(1, 12).upper() + "! post"), (31, sentence(7, 11)), (32, "ONLY-three;words"),
        (33, "only three word"), (34, "an item of six words her"), (35, LONG + " " + sentence(5, 12) + " " + LONG),
        (36, " ".join([sentence(1)] * 30)), (37, "É İ K two words two words"), (38, sentence(1, 9)),
    ]
    assert got(spark, rows, ITEMS, settings) == brute(rows, ITEMS)


def test_equals_plain_reading_on_repetitive_words(spark):
    """Few words, so that windows share shingles, overlap and repeat."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abA") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for i in range(30)]
    for settings in (Windows(width=4), Windows(width=4, shingle=1, stretch=5), Windows(width=2, shingle=3)):
        assert got(spark, rows, items, settings) == brute(rows, items, settings.width)


def test_plan_has_no_python(spark, messy):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contamination(messy, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables_and_clashing_columns(spark, messy, empty):
    items = spark.createDataFrame([(1, sentence(1), "x", 2)], "item_id long, text string, row string, n long")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, items).count() == 0
    assert contamination(messy, none).where("contaminated").count() == 0
    assert contamination(messy, items).count() == messy.count()
    clean = without_contaminated(messy, items)
    assert clean.columns == messy.columns
    ids = {r["doc_id"] for r in clean.collect()}
    assert not ids & {1, 2} and {3, 4, 5, 6, 7, 8, 9} <= ids
    assert without_contaminated(messy, none).count() == messy.count()
