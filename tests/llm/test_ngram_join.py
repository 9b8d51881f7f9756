import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import sentence

from changelens.llm import ngram_join as nj
from changelens.llm.stats import word_hashes


def brute(rows, width, num, den):
    """doc_id -> (set size, smallest id reachable), by comparing all pairs."""
    sets = []
    for _, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        sets.append(frozenset(grams or ([tuple(words)] if words else [])))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    passage = sentence(99, 60)
    rows = []
    for g in range(groups):
        words = sentence(g * 31 + seed, rng.choice([4, 12, 60, 150])).split()
        if g % 3 == 0:
            words += passage.split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            mine = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                mine[rng.randrange(len(mine))] = f"edit{rng.randrange(9)}"
            rows.append((len(rows) * 3 + 7, " ".join(mine).title() if rng.random() < 0.1 else " ".join(mine), "a"))
    return rows


@pytest.mark.parametrize("settings", [nj.CONTRACT, nj.JoinSettings(), nj.JoinSettings(frequent=3, levels=3, star_rounds=0), nj.JoinSettings(star_rounds=0, wide=1, block=8)])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(documents, settings, seed):
    rows = near_copies(seed)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(documents(rows), settings).collect()}
    assert got == set(brute(rows, settings.width, settings.num, settings.den))


@pytest.mark.parametrize("edits", [1, 2])
def test_a_large_group_of_near_copies_gives_few_links(documents, edits):
    rng = random.Random(edits)
    words = sentence(5, 110).split()
    rows = []
    for i in range(900):
        mine = list(words)
        for _ in range(rng.randint(0, edits)):
            mine[rng.randrange(len(mine))] = f"edit{rng.randrange(400)}"
        rows.append((i, " ".join(mine), "a"))
    docs = documents(rows)
    members, links = nj.similar_classes(docs, nj.CONTRACT)
    assert links.count() <= 2 * members.select("key").distinct().count()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(docs, nj.CONTRACT).collect()}
    assert got == set(brute(rows, 4, 85, 100))


def test_threshold_is_inclusive(documents):
    # 17 of 20 four-word grams are shared: 100 * 17 = 85 * 20.
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words), "a"), (2, " ".join([*words, "x", "y", "z"]), "a"), (3, " ".join([*words, *"xyzq"]), "a")]
    got = {r["doc_id"]: r["component_id"] for r in nj.near_duplicates(documents(rows), nj.CONTRACT).collect()}
    assert got == {1: 1, 2: 1, 3: 2} or got == {1: 1, 2: 1, 3: 1}
    assert {k: c for k, _, c in brute(rows, 4, 85, 100)} == got


def test_messy_rows(messy, messy_rows, empty):
    got = nj.near_duplicates(messy, nj.CONTRACT).collect()
    assert len(got) == len(messy_rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    want = {i: (n, c) for i, n, c in brute(messy_rows, 4, 85, 100) if i is not None}
    blank = {i: (0, i) for i in (3, 4, 5)}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id.items()} == want | blank
    assert nj.near_duplicates(empty, nj.CONTRACT).collect() == []


def test_one_document_of_each_group_stays(messy, empty):
    kept = nj.without_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 3, 4, 5, 6, 7, 9, 10, 11, None, None], key=str)
    assert nj.without_near_duplicates(empty).count() == 0


def test_word_hashes_do_not_depend_on_place_or_segment():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"abcXYZ\xc3\xa9!") for _ in range(rng.randint(1, 9))) for _ in range(200_000)]
    text = b" \n".join(words)
    got = word_hashes(text)
    assert len(got) == len(words)
    seen = {}
    for w, h in zip(words, got.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert (word_hashes(b"  " + words[0] + b"\t") == got[:1]).all()
    assert word_hashes(b"").size == word_hashes(b" \n").size == 0
    assert word_hashes(b"x" * (3 << 18)).size == 1


def test_filter_misses_nothing(spark):
    from changelens.llm.bloom import bloom_of

    keys = spark.range(0, 5000).selectExpr("xxhash64(id) k")
    found = bloom_of(keys, 1 << 18)
    values = np.array([r["k"] for r in keys.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    assert found.has(values).all() and found.has(others).mean() < 0.05
    assert not bloom_of(keys.where("k is null"), 1 << 18).has(values).any()
