import random
from collections import Counter

import pytest

from changelens.operators.renames import SimilarityIndex, snapshot_renames

SCHEMA = "repo string, path string, content string"


def share(a, b):
    a, b = a.split("\n"), b.split("\n")
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def plain(base, head, least=0.5, copies=False):
    """All changes by comparing every deleted with every added file."""
    status = {p: "A" for p in head if p not in base} | {p: "D" for p in base if p not in head}
    status |= {p: "M" for p in base if p in head and base[p] != head[p]}
    gone, new = (sorted(p for p in status if status[p] == s) for s in "DA")
    found = []
    for text in {base[p] for p in gone}:
        olds, news = [p for p in gone if base[p] == text], [p for p in new if head[p] == text]
        found += [(q, "R", p, 100) for p, q in zip(olds, news, strict=False)]
    old, taken = [p for p in gone if p not in {f[2] for f in found}], {f[0] for f in found}
    pairs = {(p, q): share(base[p], head[q]) for p in old for q in new if q not in taken}
    pairs = {k: s for k, s in pairs.items() if s >= least}

    def best(i, mine):
        return min((k for k in pairs if k[i] == mine), key=lambda k: (-pairs[k], k[1 - i]))

    found += [(q, "R", p, int(s * 100)) for (p, q), s in pairs.items() if best(0, p) == best(1, q) == (p, q)]
    if copies:
        for q in set(new) - {f[0] for f in found}:
            near = [(-share(base[p], head[q]), p) for p in base if p in head and share(base[p], head[q]) >= least]
            if near:
                found.append((q, "C", min(near)[1], int(-min(near)[0] * 100)))
    taken = {(f[0], "A") for f in found} | {(f[2], "D") for f in found if f[1] == "R"}
    found += [(p, s, "", 0) for p, s in status.items() if (p, s) not in taken]
    return sorted(("r", *f) for f in found)


def got(spark, rows, base, head, **options):
    frames = [spark.createDataFrame([("r", p, t) for p, t in files.items()] or [], SCHEMA) for files in (base, head)]
    return rows(snapshot_renames(*frames, **options))


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("letters", [3, 30, 500])
def test_equals_comparing_all_pairs(spark, rows, letters, copies):
    rng = random.Random(letters)
    base, head = {}, {}
    for k in range(60):
        lines = [f"l{rng.randrange(letters)}" for _ in range(rng.randint(1, 12))]
        base[f"b{k}"] = "\n".join(lines)
        for _ in range(rng.randint(0, 2)):
            other = [x if rng.random() < 0.8 else f"n{rng.randrange(letters)}" for x in lines]
            head[rng.choice([f"h{rng.randrange(90)}", f"b{rng.randrange(60)}"])] = "\n".join(other if rng.random() < 0.8 else lines)
    assert got(spark, rows, base, head, copies=copies) == plain(base, head, copies=copies)


def test_a_line_that_all_files_share_makes_no_list_of_pairs(spark, rows):
    base = {f"old/{i:04}": f"licence\nonly old {i}" for i in range(600)}
    head = {f"new/{i:04}": f"licence\nonly new {i}" for i in range(600)}
    frames = [spark.createDataFrame([("r", p, t) for p, t in files.items()], SCHEMA) for files in (base, head)]
    assert SimilarityIndex(*frames).pairs().count() == 1
    found = [r for r in got(spark, rows, base, head) if r[2] == "R"]
    assert found == [("r", "new/0000", "R", "old/0000", 50)]


def test_equal_texts_pair_in_order_and_repositories_stay_apart(spark, rows):
    base = spark.createDataFrame([("r", "a", "x\ny"), ("r", "b", "x\ny"), ("s", "c", "x\ny"), ("r", "keep", "k")], SCHEMA)
    head = spark.createDataFrame([("r", "p", "x\ny"), ("r", "q", "x\ny"), ("r", "z", "x\ny"), ("r", "keep", "k")], SCHEMA)
    assert rows(snapshot_renames(base, head)) == [
        ("r", "p", "R", "a", 100), ("r", "q", "R", "b", 100), ("r", "z", "A", "", 0), ("s", "c", "D", "", 0)
    ]
    assert rows(snapshot_renames(base.limit(0), head.limit(0), copies=True)) == []
