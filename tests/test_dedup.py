"""Test names, blocks and merging, compared with a line-by-line reading in Python."""

import random

from pyspark.sql import functions as F

from changelens.operators import dedup as dd

SCHEMA = "repo STRING, path STRING, content STRING"


def suite(spark, **contents):
    return spark.createDataFrame([("r", p, c) for p, c in contents.items()], SCHEMA)


def blocks_by_lines(content):
    """Brute force: read the lines one by one and keep the state by hand."""
    found, current = [], None
    for line in content.split("\n"):
        bare = line.strip()
        if bare.startswith(("func Test", "def test_")):
            if current is not None:
                found.append(current)
            current = line + "\n"
        elif current is not None:
            current += line + "\n"
            python = current.strip().startswith("def test_")
            if bare == "}" or (python and bare == ""):
                found.append(current)
                current = None
    return found + ([current] if current is not None else [])


def names_by_lines(content):
    found = []
    for bare in (line.strip() for line in content.split("\n")):
        if bare.startswith("func Test"):
            found.append(bare.split()[1].removesuffix("(t").removesuffix("("))
        if bare.startswith("def test_"):
            found.append(bare.split()[1].removesuffix("():").removesuffix(":"))
    return found


PIECES = [
    "func TestOne(t *testing.T) {", "func TestTwo (t *testing.T) {", "  func TestThree(", "def test_four():",
    "    def test_five(a):", "def test_six:", "}", "\t}", "  }  ", "", "   ", "body", "\tif x {", "// func TestNo(t)",
    "func Test", "func BenchmarkX(b *testing.B) {",
]


def test_names_and_blocks_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, content STRING")
    got = df.select("i", dd.test_names(F.col("content")), dd.test_blocks(F.col("content"))).collect()
    for i, names, blocks in got:
        assert list(names) == names_by_lines(texts[i]), texts[i]
        assert list(blocks) == blocks_by_lines(texts[i]), texts[i]


def test_long_blocks_do_not_overflow(spark):
    body = "func TestLong(t *testing.T) {\n" + "\tx := 1\n" * 50000 + "}\n" + "def test_next():\n" + "    y = 2\n" * 50000
    blocks = suite(spark, a=body).select(dd.test_blocks(F.col("content")).alias("b")).collect()[0].b
    assert [len(b) for b in blocks] == [len(b) for b in blocks_by_lines(body)]


def test_nested_braces_cut_a_block_unless_unindented(spark):
    body = "func TestA(t *testing.T) {\n\tfor {\n\t}\n\tdone()\n}\n"
    both = suite(spark, a=body).select(
        dd.test_blocks(F.col("content"))[0], dd.test_blocks(F.col("content"), unindented=True)[0]
    ).collect()[0]
    assert both[0] == "func TestA(t *testing.T) {\n\tfor {\n\t}\n"
    assert both[1] == body


def test_names_of_a_go_file_without_benchmarks(spark, rows):
    names = [f"TestHandler_Login_Case{i}" for i in range(8)]
    body = "".join(f"func {n}(t *testing.T) {{\n}}\n\n" for n in names) + "func BenchmarkX(b *testing.B) {\n}\n"
    assert rows(dd.exploded_names(suite(spark, a=body)), "test_name") == [(n,) for n in names]


GENERATED = (
    "package main\n\nfunc TestAdd(t *testing.T) {\n\tone()\n}\n\nfunc TestSub(t *testing.T) {\n\ttwo()\n}\n\n"
)


def test_integration_actions(spark, rows):
    names = {n: f"{n}_test.go" for n in ("same", "fresh", "other", "old")}
    generated = suite(spark, **{names[n]: GENERATED for n in ("same", "fresh", "other")}, **{"same.go": GENERATED})
    existing = suite(
        spark,
        **{
            names["same"]: "func TestAdd_More(t *testing.T) {\n}\n",
            names["other"]: "nothing here",
            names["old"]: "kept",
            "same.go": "package main\n",
        },
    )
    found = {r.path: r for r in dd.integrate_files(generated, existing).collect()}
    assert {p: r.action for p, r in found.items()} == {
        names["same"]: "skipped", names["fresh"]: "copied", names["other"]: "merged", names["old"]: "kept",
        "same.go": "kept",
    }
    assert found[names["fresh"]].content == GENERATED
    assert found[names["same"]].content == "func TestAdd_More(t *testing.T) {\n}\n"
    assert found[names["old"]].content == "kept"
    assert found["same.go"].content == "package main\n"
    assert found[names["other"]].content == "nothing here" + dd.SEPARATOR + (
        "func TestAdd(t *testing.T) {\n\tone()\n}\n\n\nfunc TestSub(t *testing.T) {\n\ttwo()\n}\n\n\n"
    )
    per_test = {r.path: r for r in dd.integrate_files(generated, existing, per_test=True).collect()}
    same = per_test[names["same"]].content
    assert "func TestSub" in same and "one()" not in same
    assert rows(dd.integration_stats(generated, existing)) == [("r", 2, 1, 4)]


def test_part_of_a_name_counts_unless_exact(spark, rows):
    tests = spark.createDataFrame([("r", "p", "TestAdd"), ("r", "p", "TestNew"), ("r", "q", "TestAdd")],
                                  "repo STRING, path STRING, name STRING")
    existing = suite(spark, p="func TestAdd_EdgeCases(t *testing.T) {\n}\n")
    assert rows(dd.new_tests(tests, existing), "path", "name") == [("p", "TestNew"), ("q", "TestAdd")]
    assert len(rows(dd.new_tests_exact(tests, existing))) == 3
    assert len(rows(dd.test_name_difference(tests, existing))) == 3


def test_new_and_matched_are_all(spark):
    names = [("r", f"p{i % 7}", f"TestF{i}_HappyPath") for i in range(60)]
    tests = spark.createDataFrame(names, "repo STRING, path STRING, name STRING")
    existing = suite(spark, **{f"p{i}": f"func TestF{i}_HappyPath(t) {{\n}}\n" for i in range(5)})
    fresh = dd.new_tests(tests, existing).count()
    known = sum(1 for _, p, n in names if p < "p5" and n == f"TestF{p[1]}_HappyPath")
    assert fresh + known == 60
    assert dd.new_tests(tests, existing.limit(0)).count() == 60


def test_contained_names_equal_a_search_of_the_text(spark, rows):
    rng = random.Random(8)
    parts = ["Test", "test_", "A", "b", "_", "(", " ", "\n", "t", "Te", "\u00a0", "é"]
    texts = {f"p{i}": "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for i in range(40)}
    names = {(p, rng.choice(["Test", "test_"]) + "".join(rng.choice(["A", "b", "_", "(", "Test", "é"]) for _ in range(rng.randint(0, 3)))) for p in texts for _ in range(12)}
    tests = spark.createDataFrame([("r", p, n) for p, n in names], "repo STRING, path STRING, name STRING")
    existing = suite(spark, **texts)
    want = sorted((p, n) for p, n in names if n not in texts[p])
    assert 50 < len(want) < len(names) - 50
    assert rows(dd.new_tests(tests, existing), "path", "name") == sorted(want, key=repr)
    others = spark.createDataFrame([("r", "p1", "b"), ("r", "p1", "no such"), ("r", "p1", "TestNone")], tests.schema)
    found = rows(dd.new_tests(others, suite(spark, p1="a b c"), any_name=True), "name")
    assert found == [("TestNone",), ("no such",)]


def test_path_join_is_a_hash_or_merge_join(spark):
    tests = spark.createDataFrame([("r", "p", "n")], "repo STRING, path STRING, name STRING")
    plan = dd.new_tests(tests, suite(spark, p="x"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matched_paths(spark, rows):
    generated = suite(spark, **{"a_test.go": "", "test_b.py": "", "b.py": "", "x/c.test.js": ""})
    found = dd.matched_paths(generated, suite(spark, **{"test_b.py": "", "b.py": "", "c.test.js": ""}))
    assert rows(found, "path", "path_exists") == [("a_test.go", False), ("test_b.py", True), ("x/c.test.js", False)]


def test_obsolete_tests(spark, rows):
    tests = spark.createDataFrame(
        [("r", n) for n in ("TestLoad_HappyPath", "TestGone_HappyPath", "test_load_edge", "TestPlain",
                               "test_load_happy_path", "test_gone_edge_cases", "TestLoad_Run", "test_load_user",
                               "TestAdd", "TestParseURL", "Test", "test_save_file")],
        "repo STRING, test_name STRING",
    )
    found = spark.createDataFrame(
        [("r", "load"), ("r", "save_file"), ("r", "add"), ("q", "gone")], "repo STRING, name STRING"
    )
    assert rows(dd.obsolete_tests(tests, found), "test_name") == [
        ("TestGone_HappyPath",), ("TestParseURL",), ("TestPlain",), ("test_gone_edge_cases",)
    ]
