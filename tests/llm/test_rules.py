import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import sentence

from changelens.llm import rules as ru
from changelens.llm.stats import covered_words, repeated_words, word_hashes, word_ids


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if counts[t] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


TEXTS = [
    None, "", " \n\t ", "a b c a b c", "x\nx\n\nx \n x\n\r\nx", "é ü 漢 \U0001f600 # * $ % & | < >", "a a a a a", "one two",
    *[sentence(i, 30 + 9 * i) for i in range(12)], "line of words\n" * 40, " ".join(f"w{i}" for i in range(60)) + " w0 w1 w2",
]


def test_base_counts(spark, documents):
    docs = documents([(i, t, "a") for i, t in enumerate(TEXTS)])
    none = spark.createDataFrame([], "doc_id long, x string")
    got = {r["doc_id"]: r for r in ru.judged(docs, none).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(r[n] for n in names) == base(t), t
        assert r["kept"] == (not r["base_failed"]) and r["score"] == 0


def test_scores_equal_the_definition(spark, documents):
    good = [(i, sentence(i, 80), "a") for i in range(30)]
    bad = [(100 + i, " ".join(f"{w}!!" for w in sentence(i, 80).split()), "a") for i in range(10)]
    docs = documents(good + bad)
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)] * 2 + [(None,), (999,)], "doc_id long")
    rules = ru.Rules(buckets=1 << 10)
    got = {r["doc_id"]: r for r in ru.judged(docs, trusted, rules).collect()}
    grams = {i: ru.ngram_buckets(t.encode(), rules.buckets) for i, t, _ in good + bad}
    every = np.bincount(np.concatenate(list(grams.values())), minlength=rules.buckets)
    mine = np.bincount(np.concatenate([grams[i] for i in range(0, 30, 2)]), minlength=rules.buckets)
    weight = rules.prior * rules.buckets
    for i, g in grams.items():
        total = 0
        for b in g:
            p = (every[b] + 1) / (every.sum() + rules.buckets)
            q = (mine[b] + weight * p) / (mine.sum() + weight)
            total += round((math.log(q) - math.log(p)) * 2**20)
        assert got[i]["score"] == pytest.approx(total / 2**20 / len(g), abs=1e-5)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= rules.threshold)
        assert len(g) == 159


def test_messy_rows(spark, messy, messy_rows, empty):
    trusted = spark.createDataFrame([(1,), (6,), (None,)], "doc_id long")
    rows = ru.judged(messy, trusted).collect()
    assert len(rows) == len(messy_rows) and ru.judged(empty, trusted).collect() == []
    by_id = {r["doc_id"]: r for r in rows}
    for i, t, _ in messy_rows:
        if i is not None:
            assert by_id[i]["n_words"] == base(t)[0] and by_id[i]["n_repeat_words"] == base(t)[4]


def test_both_ways_to_find_repeats_agree():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 5, 40, 400):
        words = [b"%d" % k for k in rng.integers(0, 6, size)]
        assert covered_words(word_hashes(b" ".join(words))) == (repeated_words(word_ids(words)) if words else 0)
