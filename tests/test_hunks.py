import random

import pytest

from changelens.operators.changes import line_changes
from changelens.operators.hunks import hunk_lines, line_hunks, longest_rising


def rising_by_table(values):
    """Longest rising run by dynamic programming, the last index first."""
    length = []
    for i, v in enumerate(values):
        length.append(1 + max((length[j] for j in range(i) if values[j] < v), default=0))
    run, need, at = [], max(length, default=0), len(values)
    while need:
        at = max(j for j in range(at) if length[j] == need and (not run or values[j] < values[run[0]]))
        run.insert(0, at)
        need -= 1
    return run


def plain(a, b, i=0, j=0):
    """Patience difference by recursion over lists of lines: (base_start, base_lines, head_start, head_lines)."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b, i, j = a[n:], b[n:], i + n, j + n
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a and not b:
        return []
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    pairs = [(a.index(x), b.index(x)) for x in once]
    kept = [pairs[k] for k in rising_by_table([q for _, q in pairs])]
    if not kept:
        return [(i + bool(a), len(a), j + bool(b), len(b))]
    found, p, q = [], 0, 0
    for x, y in [*kept, (len(a), len(b))]:
        found += plain(a[p:x], b[q:y], i + p, j + q)
        p, q = x + 1, y + 1
    return found


def edited(rng, lines, alphabet):
    out = list(lines)
    for _ in range(rng.randint(0, 6)):
        at = rng.randint(0, len(out))
        action = rng.choice(["insert", "delete", "move", "change"])
        if action == "insert" or not out:
            out.insert(at, alphabet())
        elif action == "move":
            out.insert(at, out.pop(rng.randrange(len(out))))
        elif action == "delete":
            out.pop(rng.randrange(len(out)))
        else:
            out[rng.randrange(len(out))] = alphabet()
    return out or [""]


def hunks_of(spark, rows, pairs):
    base = spark.createDataFrame([("r", str(k), "\n".join(a)) for k, (a, _) in pairs.items()], "repo string, path string, content string")
    head = spark.createDataFrame([("r", str(k), "\n".join(b)) for k, (_, b) in pairs.items()], "repo string, path string, content string")
    found = {}
    for _, path, *hunk in rows(line_hunks(base, head)):
        found.setdefault(int(path), []).append(tuple(hunk))
    return {k: sorted(v) for k, v in found.items()}


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


@pytest.mark.parametrize("letters", [4, 12, 1000])
def test_equal_to_plain_reading_on_random_edits(spark, rows, letters):
    rng = random.Random(letters)
    pairs = {}
    for k in range(60):
        lines = [f"l{rng.randrange(letters)}" for _ in range(rng.randint(1, 40))]
        pairs[k] = lines, edited(rng, lines, lambda: f"l{rng.randrange(letters)}")
    want = {k: sorted(plain(a, b)) for k, (a, b) in pairs.items() if a != b}
    assert hunks_of(spark, rows, pairs) == want


def test_unique_lines_keep_a_longest_common_run(spark, rows):
    rng = random.Random(9)
    pairs = {}
    for k in range(40):
        lines = [f"{k} {i}" for i in range(rng.randint(2, 60))]
        new = iter(range(1000))
        pairs[k] = lines, edited(rng, lines, lambda new=new: f"new {next(new)}")
    for k, hunks in hunks_of(spark, rows, pairs).items():
        a, b = pairs[k]
        assert len(a) - sum(h[1] for h in hunks) == lcs(a, b)
        rebuilt, at = [], 0
        for start, n, head_start, n_head in hunks:
            begin = start - 1 if n else start
            rebuilt += a[at:begin] + b[head_start - 1 : head_start - 1 + n_head] * bool(n_head)
            at = begin + n
        assert rebuilt + a[at:] == b


def test_added_deleted_and_moved(spark, rows):
    schema = "repo string, path string, content string"
    base = spark.createDataFrame([("r", "gone", "a\nb"), ("r", "moved", "a\nb\nc\nd"), ("r", "same", "x")], schema)
    head = spark.createDataFrame([("r", "new", "a\nb\n"), ("r", "moved", "b\nc\nd\na"), ("r", "same", "x")], schema)
    hunks = line_hunks(base, head)
    assert rows(hunks) == [("r", "gone", 1, 2, 0, 0), ("r", "moved", 1, 1, 0, 0), ("r", "moved", 4, 0, 4, 1), ("r", "new", 0, 0, 1, 3)]
    assert ("r", "moved", 1, 1) in rows(hunk_lines(hunks))
    assert ("r", "moved", 0, 0) in rows(line_changes(base, head).select("repo", "path", "lines_added", "lines_removed"))
    assert rows(line_hunks(base.limit(0), head.limit(0))) == []


def test_longest_rising_run():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(50), rng.randint(0, 20))
        assert longest_rising(values) == rising_by_table(values)
    assert len(longest_rising(list(range(200_000)))) == 200_000
