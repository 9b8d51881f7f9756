import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from check_oracle import difference, duck
from conftest import SF

from changelens.llm import oracle, queries
from changelens.llm.radix import ranked
from changelens.llm.resampling import Resampling, drawn_documents, feature_buckets, resampled, word_lists


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, width):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, s):
    def bucket(f):
        return zlib.crc32(f.encode()) % s.buckets

    raw = Counter(bucket(f) for _, t in rows for f in features(t, s.width))
    aim = Counter(bucket(f) for t in target for f in features(t, s.width))
    all_raw, all_aim = sum(raw.values()), sum(aim.values())
    gain = [
        math.floor(1000 * math.log((aim[b] + 1) * (all_raw + s.buckets) / ((raw[b] + 1) * (all_aim + s.buckets))))
        for b in range(s.buckets)
    ]
    out = []
    for i, t in rows:
        held = features(t, s.width)
        weight = sum(gain[bucket(f)] for f in held)
        h = int(hashlib.sha256(f"{s.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    order = sorted((r for r in out if r[5] >= s.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(order[: len(order) * s.percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(rows, target, spark, s):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), s).collect()), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_equals_sql(spark):
    frame = queries.op11_importance_resampling(spark, SF).toPandas()
    assert difference(frame, duck(SF).sql(oracle.OP11_IMPORTANCE_RESAMPLING).df()) == ""


@pytest.mark.parametrize("width", [1, 3])
def test_equals_plain_reading_on_messy_rows(spark, messy_rows, width):
    rows = [(i, t) for i, t, _ in messy_rows] + [(20, "İ É K Ω a-b"), (21, "x" * 3_000_000)]
    target = ["quick brown fox", None, "", "JUMPS over word1"]
    s = Resampling(width=width, buckets=97, percent=40, min_words=2, seed=7)
    assert got(rows, target, spark, s) == brute(rows, target, s)


def test_ties_repeats_and_a_hot_score(spark):
    rows = [(i % 50, "same words here") for i in range(400)] + [(i, f"a{i % 7} b c") for i in range(60)]
    s = Resampling(buckets=11, percent=90, min_words=3, steps=3)
    assert got(rows, ["same b"], spark, s) == brute(rows, ["same b"], s)


def test_empty_tables_and_clashing_columns(spark, messy, empty):
    target = spark.createDataFrame([], "text string")
    assert resampled(empty, target).count() == 0
    out = resampled(messy, target, Resampling(min_words=1, percent=100))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert out.count() == messy.count()
    assert resampled(messy, target, Resampling(percent=0)).where("rank is not null").count() == 0
    drawn = drawn_documents(messy, target, Resampling(min_words=20, percent=50))
    assert drawn.columns == messy.columns and 0 < drawn.count() < messy.count()


def test_long_texts_are_cut_between_words():
    text = (b"ab, cd " * 700_000) + b"x" * 50
    parts = list(word_lists(text))
    assert len(parts) > 2 and sum(parts, []) == [b"ab", b"cd"] * 700_000 + [b"x" * 50]
    found, n = feature_buckets(text, Resampling(width=2, buckets=1 << 20))
    assert n == 1_400_001 and sum(map(len, found)) == 2 * n - 1


@pytest.mark.parametrize("digit_bits,block_bits", [(11, 15), (3, 2), (5, 4)])
def test_radix_ranks(spark, digit_bits, block_bits):
    rng = random.Random(5)
    keys = [(rng.choice([-5, 0, 3]), rng.randint(-(1 << 40), 1 << 40), rng.randint(0, 3)) for _ in range(300)] + [(0, 0, 0)] * 50
    rows = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "a long, b long, c long, n long")
    out = ranked(rows, ["a", "b", "c"], digit_bits, block_bits).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 351))
    assert [(r["a"], r["b"], r["c"]) for r in out] == sorted(keys)
    assert sorted(r["n"] for r in out) == list(range(350))


def test_radix_over_the_whole_range_of_a_long(spark):
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 5]
    out = ranked(spark.createDataFrame([(k,) for k in ends], "k long"), ["k"]).orderBy("rank").collect()
    assert [r["k"] for r in out] == sorted(ends)
    assert ranked(spark.createDataFrame([], "k long"), ["k"]).count() == 0
