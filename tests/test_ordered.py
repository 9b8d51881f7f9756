"""Look-back by slices, compared with a reading row by row."""

import random

from pyspark.sql import functions as F

from changelens.operators.ordered import carry_forward


def brute_force(data):
    """Last known value among the earlier rows of a key."""
    last, out = {}, {}
    for key, ts, ident, value in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        out[ident] = last.get(key)
        if value is not None:
            last[key] = value
    return out


def check(spark, data, slices):
    df = spark.createDataFrame(data, "k STRING, ts INT, id INT, v INT").repartition(4)
    found = carry_forward(df, ["k"], ["ts", "id"], F.col("v"), "before", slices)
    got = {r.id: r.before for r in found.select("id", "before").collect()}
    assert got == brute_force(data)
    return found


def test_hot_key_is_cut_into_slices(spark):
    rng = random.Random(3)
    data = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", rng.randint(0, 50), i,
         rng.randint(0, 9) if rng.random() < 0.2 else None)
        for i in range(3000)
    ]
    check(spark, data, 7)


def test_one_key_at_one_instant(spark):
    data = [("hot", 1, i, i if i % 5 == 0 else None) for i in range(800)]
    check(spark, data, 6)


def test_no_known_values_and_no_rows(spark):
    check(spark, [("a", i, i, None) for i in range(40)], 3)
    check(spark, [], 3)


def test_values_only_in_the_first_slice(spark):
    data = [("hot", i, i, 5 if i == 0 else None) for i in range(500)]
    check(spark, data, 9)


def test_rows_without_a_key_are_a_group_of_their_own(spark):
    data = [(None if i % 3 else "b", i, i, i if i % 50 == 0 else None) for i in range(400)]
    check(spark, data, 8)


def test_no_task_window_spans_a_whole_key(spark):
    df = spark.createDataFrame([("a", 1, 1, 1)], "k STRING, ts INT, id INT, v INT")
    found = carry_forward(df, ["k"], ["ts", "id"], F.col("v"), "before", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_slice" in line for line in windows)
