from changelens.config import JobConfig
from changelens.operators import changes as ch
from changelens.operators import symbols as sy
from changelens.operators import testplan as tp
from changelens.plans import runs
from changelens.sources.changes import parse_change_lines

SCHEMA = "repo STRING, pr_id INT, path STRING, content STRING"
GO = "type Box struct {\n}\nfunc (b *Box) open(n int) {}\nfunc build() {}\n"
PY = "def load(a):\n    pass\nclass Model:\n    pass\n"
JS = "function draw() {}\n"


def files(spark, *pairs):
    return spark.createDataFrame([("r", 1, p, c) for p, c in pairs], SCHEMA)


def test_case_names_per_kind(spark, rows):
    cases = tp.unit_cases(sy.symbols(files(spark, ("x/a.go", GO))))
    assert rows(cases, "name", "case_type", "description") == sorted(
        [
            ("TestOpen_HappyPath", "happy_path", "Test open with valid inputs"),
            ("TestOpen_EdgeCases", "edge_case", "Test open with edge case inputs"),
            ("TestOpen_ErrorHandling", "error_handling", "Test open error handling"),
            ("TestBuild_HappyPath", "happy_path", "Test build with valid inputs"),
            ("TestBuild_EdgeCases", "edge_case", "Test build with edge case inputs"),
            ("TestBuild_ErrorHandling", "error_handling", "Test build error handling"),
            ("TestBox_Open", "method_test", "Test Box.open"),
        ],
        key=repr,
    )


def test_edge_cases_can_be_switched_off_and_cases_capped(spark):
    found = sy.symbols(files(spark, ("a.py", PY)))
    assert tp.unit_cases(found, JobConfig(generate_edge_cases=False)).count() == 2
    assert tp.unit_cases(found, JobConfig(max_tests_per_function=1), cap=True).count() == 1


def test_unsupported_pairs_have_no_code(spark, rows):
    cases = tp.unit_cases(sy.symbols(files(spark, ("a.js", JS))))
    assert [(n, code != "") for n, code in rows(cases, "case_type", "code")] == [
        ("edge_case", False),
        ("error_handling", False),
        ("happy_path", True),
    ]


def test_run_of_renames_only_has_counters_of_zero(spark, rows):
    listed = spark.createDataFrame([("r", 4, "R100\ta.go\tb.go"), ("r", 5, "T\tx.go")], "repo STRING, pr_id INT, line STRING")
    analysis = runs.ChangeAnalysis(parse_change_lines(listed), files(spark))
    assert rows(analysis.generation_stats()) == [("r", 4, 0, 0, 0, 0), ("r", 5, 0, 0, 0, 0)]


def test_plan_and_counters_agree(spark, rows):
    listed = spark.createDataFrame(
        [("r", 1, line) for line in ("M\tx/a.go", "M\ty/b.py", "A\tz/c.py", "D\td.go", "M\te.md")],
        "repo STRING, pr_id INT, line STRING",
    )
    sources = files(spark, ("x/a.go", GO), ("y/b.py", PY), ("z/c.py", PY), ("d.go", GO))
    changes = parse_change_lines(listed)
    analysis = runs.ChangeAnalysis(changes, sources)
    assert rows(analysis.modules, "module") == [("x",), ("y",)]
    plan = analysis.test_plan()
    stats = tp.generation_stats(ch.routed(changes), analysis.symbols).collect()[0]
    # functions build, open, load; classes Box, Model; modules x, y
    assert stats.unit_tests_generated == 7
    assert stats.functional_tests_generated == 1
    assert stats.files_processed == 3
    assert stats.total_test_cases == plan.count() == 3 * 3 + 1 + 1 + 2
    by_type = {r.case_type: r["count"] for r in plan.groupBy("case_type").count().collect()}
    assert by_type == {
        "happy_path": 3, "edge_case": 3, "error_handling": 3, "method_test": 1, "e2e": 1, "integration": 2,
    }
    assert rows(plan.where("case_type = 'e2e'"), "name", "test_path") == [("TestBox_E2E", "test_Box_functional.go")]
    assert ("TestX_Integration", "test_x_integration_test.go") in rows(plan, "name", "test_path")


def test_plan_matches_separate_functional_cases(spark, rows):
    found = sy.symbols(files(spark, ("x/a.go", GO)))
    modules = ch.affected_modules(files(spark, ("x/a.go", GO)))
    columns = ("name", "description", "case_type", "code", "test_path")
    planned = tp.test_plan(found, modules).where("case_type = 'e2e'")
    assert rows(planned, *columns) == rows(tp.functional_cases(sy.semantic_changes(found)), *columns)


def test_added_files_are_analyzed_on_request(spark, rows):
    listed = spark.createDataFrame([("r", 1, "A\ta.py")], "repo STRING, pr_id INT, line STRING")
    sources = files(spark, ("a.py", PY))
    changes = parse_change_lines(listed)
    assert runs.modified_sources(changes, sources).count() == 0
    assert runs.modified_sources(changes, sources, JobConfig(include_added=True)).count() == 1


def test_file_text_is_header_then_cases(spark):
    row = tp.unit_test_files(files(spark, ("x/b.py", "def load(a):\n    pass\n"))).collect()[0]
    assert row.test_path == "x/test_b.py"
    assert row.n_cases == 3
    parts = row.content.split("\n\n")
    assert parts[0] == '"""Test framework: pytest"""'
    assert parts[2].startswith("# Test load with valid inputs\ndef test_load_happy_path():")
    assert row.content.endswith("\n\n")


def test_class_without_methods_gives_a_file_with_a_header_only(spark):
    row = tp.unit_test_files(files(spark, ("b.py", "class Model:\n    pass\n"))).collect()[0]
    assert row.n_cases == 0 and row.content.endswith("import pytest\n\n")


def test_last_writer_wins_in_the_flat_layout(spark, rows):
    found = tp.unit_test_files_last_writer(
        files(
            spark,
            ("a/m.py", "def early():\n  pass\n"),
            ("b/m.py", "def late():\n  pass\n"),
            ("a/n.py", "def f():\n  pass\nclass Last:\n  pass\n"),
            ("b/n.py", "def g():\n  pass\n"),
        )
    )
    assert rows(found, "test_path", "symbol", "n_cases") == [("test_m.py", "late", 3), ("test_n.py", "Last", 0)]


def test_single_case_files_drop_repeats(spark, rows):
    found = sy.symbols(files(spark, ("a/x.go", "type T struct {\n}\n"), ("b/x.go", "type T struct {\n}\n")))
    cases = tp.functional_cases(sy.semantic_changes(found))
    assert cases.count() == 2
    assert rows(tp.single_case_files(cases), "test_path") == [("test_T_functional.go",)]


def test_prompts_hold_the_whole_source(spark):
    body = "def load(a):\n    return '{name} {kind}'\n" + "# line\n" * 5000
    found = sy.symbols(files(spark, ("a.py", body)), keep_content=True)
    prompt = tp.function_prompts(found).collect()[0].prompt
    assert body in prompt and "load" in prompt.split("\n")[0]
    assert body in tp.file_prompts(files(spark, ("a.py", body))).collect()[0].prompt


def test_stored_answer_becomes_one_more_case(spark, rows):
    cases = tp.unit_cases(sy.symbols(files(spark, ("a.py", "def f():\n  pass\ndef g():\n  pass\n"))))
    stored = spark.createDataFrame(
        [("r", 1, "a.py", "f", "code"), ("r", 1, "a.py", "g", "")],
        "repo STRING, pr_id INT, path STRING, symbol STRING, answer STRING",
    )
    assert rows(tp.enhanced_cases(cases, stored), "name", "code") == [("TestF_Enhanced", "code")]


def test_names_by_pattern(spark, rows):
    found = tp.names_by_pattern(sy.symbols(files(spark, ("a.js", JS))), JobConfig(unit_pattern="check_{function_name}"))
    assert rows(found, "unit_name", "functional_name") == [("check_draw", "test_draw_e2e")]


def test_worked_functional_candidate(spark, rows):
    kept = tp.path_rules(files(spark, ("src/api/login_handler.go", "")))
    assert rows(kept, "path", "wants_functional") == [("src/api/login_handler.go", True)]
