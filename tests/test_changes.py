from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import paths
from changelens.operators import changes as ch
from changelens.operators import rules
from changelens.sources.changes import parse_change_lines


def lines(spark, *values):
    return spark.createDataFrame([("r", 1, v) for v in values], "repo STRING, pr_id INT, line STRING")


def test_change_lines_split_on_whitespace(spark, rows):
    parsed = parse_change_lines(lines(spark, "M\ta.go", "  A   b.py  ", "", "M", "R100\told\tnew", "D\tmy file.go"))
    assert rows(parsed, "status", "path") == [("A", "b.py"), ("D", "my"), ("M", "a.go"), ("R100", "old")]


def test_change_lines_split_on_tabs_keep_spaces(spark, rows):
    parsed = parse_change_lines(lines(spark, "D\tmy file.go"), tab_separated=True)
    assert rows(parsed, "path") == [("my file.go",)]


def test_renames_are_dropped_unless_asked_for(spark, rows):
    parsed = parse_change_lines(lines(spark, "M\ta", "A\tb", "D\tc", "R90\td\te", "T\tf"))
    assert rows(ch.routed(parsed), "status_class") == [("A",), ("D",), ("M",)]
    assert rows(ch.routed(parsed, include_renames=True), "path") == [("a",), ("b",), ("c",), ("d",)]


def test_only_modified_files_are_analyzed_by_default(spark, rows):
    parsed = parse_change_lines(lines(spark, "M\ta", "A\tb", "MM\tc"))
    assert rows(ch.modified_files(parsed), "path") == [("a",), ("c",)]
    assert rows(ch.modified_files(parsed, include_added=True), "path") == [("a",), ("b",), ("c",)]


def test_status_filter_reaches_the_scan(spark, tmp_path):
    table = str(tmp_path / "changes")
    parse_change_lines(lines(spark, "M\ta", "A\tb")).write.parquet(table)
    plan = ch.modified_files(spark.read.parquet(table))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(status,M)" in plan


def test_patch_lines_and_missing_patch(spark, rows):
    changes = parse_change_lines(lines(spark, "M\ta.go", "M\tb.go"))
    diff = "--- a/a.go\n+++ b/a.go\n@@ -1 +1,2 @@\n same\n-old\n+new\n+more\n"
    patches = spark.createDataFrame([("r", 1, "a.go", diff)], "repo STRING, pr_id INT, path STRING, diff STRING")
    found = ch.file_changes(changes, patches)
    assert rows(found, "path", "language", "lines_changed", "lines_added", F.length("diff")) == [
        ("a.go", "go", 3, 2, len(diff)),
        ("b.go", "go", 0, 0, 0),
    ]


def test_worked_change_filter(spark, rows):
    listed = lines(
        spark, "M\tsrc/api/order_service.go", "A\tsrc/api/login_handler.go", "M\tREADME.md", "M\tconfig.yaml"
    )
    kept = ch.analyzable_files(parse_change_lines(listed))
    assert rows(kept, "path") == [("src/api/login_handler.go",), ("src/api/order_service.go",)]
    assert rows(ch.affected_modules(kept), "module") == [("src",)]


def test_snapshots_give_status_and_line_counts(spark, rows):
    schema = "repo STRING, path STRING, content STRING"
    base = spark.createDataFrame(
        [("r", "same", "x\ny"), ("r", "gone", "a\nb"), ("r", "edit", "1\n2\n2\n3"), ("r", "moved", "p\nq")], schema
    )
    head = spark.createDataFrame(
        [("r", "same", "x\ny"), ("r", "new", "n"), ("r", "edit", "1\n2\n4\n4"), ("r", "moved", "q\np")], schema
    )
    found = ch.snapshot_changes(base, head)
    assert rows(found, "path", "status", "lines_added", "lines_removed", "lines_changed") == [
        ("edit", "M", 2, 2, 4),
        ("gone", "D", 0, 2, 2),
        ("moved", "M", 0, 0, 0),
        ("new", "A", 1, 0, 1),
    ]
    assert rows(ch.snapshot_changes(base, base)) == []
    assert rows(ch.line_changes(base, base)) == []


def test_preview_counts_the_rest(spark, rows):
    data = [("r", 1, i, f"f{i:02}") for i in range(13)] + [("r", 2, 0, "only")]
    changes = spark.createDataFrame(data, "repo STRING, pr_id INT, seq INT, path STRING")
    found = ch.preview(changes, ["seq"], 10)
    assert rows(found.where("pr_id = 1"), "path", "n_more") == [(f"f{i:02}", 3) for i in range(10)]
    assert rows(found.where("pr_id = 2"), "path", "rank", "n_more") == [("only", 1, 0)]


def test_preview_limits_before_the_shuffle(spark):
    changes = spark.createDataFrame([("r", 1, 1, "p")], "repo STRING, pr_id INT, seq INT, path STRING")
    plan = ch.preview(changes, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    assert plan.count("WindowGroupLimit") == 2


def test_counts_and_new_lines(spark, rows):
    data = [("r", 1, "M", "a", 3), ("r", 1, "A", "b", 4), ("r", 1, "D", "c", 5), ("r", 2, "D", "d", 1)]
    changes = spark.createDataFrame(data, "repo STRING, pr_id INT, status STRING, path STRING, lines_changed INT")
    assert rows(ch.status_counts(changes)) == [("r", 1, 1, 1, 1), ("r", 2, 0, 0, 1)]
    assert rows(ch.new_lines(changes)) == [("r", 1, 7)]
    assert rows(ch.file_counts(changes)) == [("r", 1, 3), ("r", 2, 1)]


def test_rules(spark, rows):
    data = [
        (p, n)
        for p, n in [
            ("a.go", 5), ("b.go", 4), ("a_test.go", 9), ("x/test_a.py", 9), ("a.test.js", 9), ("a.spec.ts", 9),
            ("vendor/a.go", 9), ("x/node_modules/a.js", 9), ("a.rb", 9), ("x/a.java", 9), ("myvendor/a.go", 9),
        ]
    ]
    changes = spark.createDataFrame(data, "path STRING, lines_changed INT")
    kept = rules.included(rules.large_enough(changes, JobConfig()))
    assert rows(kept, "path") == [("a.go",), ("myvendor/a.go",), ("x/a.java",)]


PATHS = ["a.go", "src/b.PY", "x.d/c", "src/d.tsx", "e.java", "docs/f.md", ".env", "g h.ts", "m.test.js"]


def test_path_expressions(spark, rows):
    path = F.col("p")
    df = spark.createDataFrame([(p,) for p in PATHS], "p STRING").select(
        path,
        paths.language(path),
        paths.test_language(path),
        paths.display_language(path),
        paths.extension(path),
        paths.stem(path),
        paths.dir_name(path),
        paths.module(path),
        paths.is_test_file(path),
    )
    assert rows(df) == sorted(
        [
            ("a.go", "go", "go", "Go", ".go", "a", ".", None, False),
            ("src/b.PY", "python", "python", "PY", ".PY", "b", "src", "src", False),
            ("x.d/c", "unknown", "go", "d/c", "", "c", "x.d", "x.d", False),
            ("src/d.tsx", "unknown", "go", "JavaScript/TypeScript", ".tsx", "d", "src", "src", False),
            ("e.java", "java", "java", "Java", ".java", "e", ".", None, False),
            ("docs/f.md", "unknown", "go", "md", ".md", "f", "docs", "docs", False),
            (".env", "unknown", "go", "env", ".env", "", ".", None, False),
            ("g h.ts", "typescript", "typescript", "JavaScript/TypeScript", ".ts", "g h", ".", None, False),
            ("m.test.js", "javascript", "javascript", "JavaScript/TypeScript", ".js", "m.test", ".", None, True),
        ],
        key=repr,
    )


def test_naming_rules(spark, rows):
    path = F.col("p")
    data = ["a/b.go", "a/b.py", "a/b.js", "a/b.ts", "a/b.java", "a/b.rb", "b"]
    df = spark.createDataFrame([(p,) for p in data], "p STRING").select(
        path,
        paths.flat_test_name(path, paths.language(path)),
        paths.test_path_beside(path),
        paths.test_path_beside(path, "functional"),
    )
    assert rows(df) == sorted(
        [
            ("a/b.go", "b_test.go", "a/b_test.go", "functional/a/b_test.go"),
            ("a/b.py", "test_b.py", "a/test_b.py", "functional/a/test_b.py"),
            ("a/b.js", "test_b.js", "a/b.test.js", "functional/a/b.test.js"),
            ("a/b.ts", "test_b.ts", "a/b.test.ts", "functional/a/b.test.ts"),
            ("a/b.java", "test_b.java", "a/bTest.java", "functional/a/bTest.java"),
            ("a/b.rb", "test_b.go", "a/b_test.rb", "functional/a/b_test.rb"),
            ("b", "test_b.go", "./b_test.b", "functional/./b_test.b"),
        ],
        key=repr,
    )


def test_path_rules(spark, rows):
    path = F.col("p")
    data = ["src/api/a.go", "docs/a.go", "x/docs/a.go", "a_test.go", "test_a.py", "a.test.ts", "a.yml", "a.md"]
    df = spark.createDataFrame([(p,) for p in data], "p STRING").where(~paths.is_skipped(path))
    assert rows(df.select(path, paths.is_functional_candidate(path))) == [
        ("src/api/a.go", True),
        ("test_a.py", False),
        ("x/docs/a.go", False),
    ]
