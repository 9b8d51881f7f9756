import random

import pytest

from changelens.operators.covered import covered_lines, covered_totals, hunk_ranges, patch_ranges
from changelens.sources.profiles import profile_ranges

KEY = "repo string, path string"


def test_parsers_read_the_three_formats(spark, rows):
    go = "mode: set\npkg/a.go:3.10,5.2 2 1\npkg/a.go:7.1,7.9 1 0\nbad line\npkg/b:c.go:1.1,1.2 1 12\npkg/a.go:9.1,8.1 1 1"
    lcov = "TN:\nSF:src/x.js\nDA:1,1\nDA:2,0,abc\nDA:x,1\nend_of_record\nSF:y.js\nDA:4,7\nend_of_record\nDA:9,9\n"
    json = '{"files": {"m.py": {"executed_lines": [1, 2], "missing_lines": [4]}, "n.py": {"executed_lines": []}}}'
    reports = spark.createDataFrame(
        [("r", "go", go), ("r", "javascript", lcov), ("r", "python", json), ("r", "python", "{"), ("r", "go", None), ("r", "other", go), ("r", "go", "")],
        "repo string, tool string, body string",
    )
    assert rows(profile_ranges(reports, ("repo",))) == sorted(
        [
            ("r", "pkg/a.go", 3, 5, 1), ("r", "pkg/a.go", 7, 7, 0), ("r", "pkg/b:c.go", 1, 1, 12),
            ("r", "src/x.js", 1, 1, 1), ("r", "src/x.js", 2, 2, 0), ("r", "y.js", 4, 4, 7),
            ("r", "m.py", 1, 1, 1), ("r", "m.py", 2, 2, 1), ("r", "m.py", 4, 4, 0),
        ],
        key=repr,
    )


def plain(changed, ranges):
    out = {}
    for key in {c[:2] for c in changed}:
        new = {n for r, p, s, e in changed if (r, p) == key for n in range(s, e + 1)}
        known = {n for r, p, s, e, _ in ranges if (r, p) == key for n in range(s, e + 1)}
        ran = {n for r, p, s, e, h in ranges if (r, p) == key and h for n in range(s, e + 1)}
        out[key] = (len(new), len(new & known), len(new & ran), any(r[:2] == key for r in ranges))
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_equals_sets_of_lines(spark, rows, seed):
    rng = random.Random(seed)

    def some(n, hits):
        found = []
        for _ in range(n):
            start = rng.choice([1, 62, 63, 64, 65, 127, 128, rng.randint(1, 700)])
            found.append(("r", f"f{rng.randint(0, 4)}", start, start + rng.choice([0, 0, 1, 3, 63, 64, 200]), *([rng.randint(0, 2)] if hits else [])))
        return found

    changed, ranges = some(40, False), [r for r in some(200, True) if r[1] != "f4"]
    got = covered_lines(
        spark.createDataFrame(changed, f"{KEY}, start long, end long"), spark.createDataFrame(ranges, f"{KEY}, start long, end long, hits long")
    )
    assert rows(got) == plain(changed, ranges)


def test_hot_file_is_one_row_per_bin(spark):
    """One file with 60,000 overlapping ranges on either side: no pairs of ranges are made."""
    changed = spark.range(60_000).selectExpr("'r' repo", "'hot' path", "id % 6000 + 1 start", "id % 6000 + 50 end")
    ranges = spark.range(60_000).selectExpr("'r' repo", "'hot' path", "id % 6000 + 26 start", "id % 6000 + 75 end", "id % 2 hits")
    (row,) = covered_lines(changed, ranges).collect()
    assert tuple(row)[2:5] == (6049, 6024, 6023)


def test_patches_and_hunks_give_ranges(spark, rows):
    diff = "--- a/x\n+++ b/x\n@@ -1,4 +1,5 @@ f()\n a\n-b\n+B\n+C\n d\n\\ No newline\n+e\n@@ -10 +12,2 @@\n-z\n+y\n x\n"
    patches = spark.createDataFrame(
        [("r", 1, "x", diff), ("r", 1, "none", "--- a\n+++ b\n"), ("r", 1, "empty", ""), ("r", 1, "null", None)],
        "repo string, pr_id long, path string, diff string",
    )
    assert rows(patch_ranges(patches)) == [("r", 1, "x", 12, 12), ("r", 1, "x", 2, 3), ("r", 1, "x", 5, 5)]
    hunks = spark.createDataFrame([("r", "x", 1, 1, 0, 0), ("r", "x", 2, 0, 3, 2)], f"{KEY}, base_start long, base_lines long, head_start long, head_lines long")
    assert rows(hunk_ranges(hunks)) == [("r", "x", 3, 4)]


def test_estimate_where_there_is_no_data(spark, rows):
    per_file = spark.createDataFrame([("r", 1, "a", 5, 4, 3, True), ("r", 1, "b", 9, 0, 0, False), ("r", 2, "c", 7, 0, 0, False)], "repo string, pr_id long, path string, n_new long, n_known long, n_covered long, has_data boolean")
    totals = spark.createDataFrame([("r", 1, 20), ("r", 2, 10), ("r", 3, 10)], "repo string, pr_id long, new_lines_total long")
    symbols = spark.createDataFrame([("r", 1, 3), ("r", 2, 1)], "repo string, pr_id long, n_symbols long")
    assert rows(covered_totals(per_file, totals, symbols)) == [
        ("r", 1, 3, 14, 4, 20, True), ("r", 2, 7, 7, 10, 10, False), ("r", 3, 0, 0, 10, 10, False)
    ]
