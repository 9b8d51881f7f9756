import datetime as dt

import pytest
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import fixed
from changelens.operators import coverage as cov
from changelens.sources import coverage as src


def at(minute):
    return dt.datetime(2026, 4, 8, 5, minute)


def report(spark, before, after, total=200, symbols=3, config=JobConfig()):
    runs = spark.createDataFrame(
        [("r", 1, at(0), before, after)],
        "repo STRING, pr_id INT, ts TIMESTAMP_NTZ, coverage_before DOUBLE, pct DOUBLE",
    )
    lines = spark.createDataFrame([("r", 1, total)], "repo STRING, pr_id INT, new_lines_total BIGINT")
    counts = spark.createDataFrame([("r", 1, symbols)], "repo STRING, pr_id INT, n_symbols BIGINT")
    return cov.coverage_report(runs, lines, counts, config)


def test_report_of_the_sample(spark):
    row = report(spark, 75.5, 82.3).collect()[0]
    assert row.coverage_delta == pytest.approx(6.8, abs=1e-9)
    assert row.target_met and row.new_lines_total == 200 and row.new_lines_covered == 140


def test_report_below_target(spark):
    df = cov.gates(report(spark, 65.0, 78.0))
    row = df.collect()[0]
    assert row.coverage_delta == 13 and not row.target_met and row.shortfall == 2
    assert row.decrease_ok and row.increase_ok


def test_defaults_of_missing_values(spark):
    none = report(spark, None, None).collect()[0]
    assert (none.coverage_before, none.coverage_after, none.coverage_delta) == (0.0, 0.0, 0.0)
    first = cov.gates(report(spark, None, 40.0), JobConfig(min_coverage_increase=1.0)).collect()[0]
    assert (first.coverage_before, first.coverage_after, first.coverage_delta) == (40.0, 40.0, 0.0)
    assert first.decrease_ok and not first.increase_ok
    kept = report(spark, 40.0, None).collect()[0]
    assert (kept.coverage_after, kept.coverage_delta) == (40.0, 0.0)


def test_estimate_is_truncated_from_a_double(spark):
    assert report(spark, 1.0, 1.0, total=90).collect()[0].new_lines_covered == int(float(90) * 0.7) == 62
    assert report(spark, 1.0, 1.0, total=90, symbols=0).collect()[0].new_lines_covered == 0
    df = spark.range(0, 3000).select("id", cov.covered_estimate(F.col("id"), F.lit(1)).alias("c"))
    assert all(r.c == int(float(r.id) * 0.7) for r in df.collect())


def test_measured_lines_go_before_the_estimate(spark, rows):
    runs = spark.createDataFrame(
        [("r", n, at(0), 1.0, 2.0) for n in (1, 2)], "repo STRING, pr_id INT, ts TIMESTAMP_NTZ, coverage_before DOUBLE, pct DOUBLE"
    )
    lines = spark.createDataFrame([("r", 1, 10), ("r", 2, 10)], "repo STRING, pr_id INT, new_lines_total BIGINT")
    counts = spark.createDataFrame([("r", 1, 1), ("r", 2, 1)], "repo STRING, pr_id INT, n_symbols BIGINT")
    measured = spark.createDataFrame([("r", 1, 3)], "repo STRING, pr_id INT, n_covered BIGINT")
    found = cov.coverage_report(runs, lines, counts, measured=measured)
    assert rows(found, "pr_id", "new_lines_covered", "new_lines_covered_est") == [(1, 3, 7), (2, 7, 7)]


def test_request_without_files_or_symbols(spark):
    runs = spark.createDataFrame(
        [("r", 9, at(0), 1.0, 2.0)], "repo STRING, pr_id INT, ts TIMESTAMP_NTZ, coverage_before DOUBLE, pct DOUBLE"
    )
    lines = spark.createDataFrame([], "repo STRING, pr_id INT, new_lines_total BIGINT")
    counts = spark.createDataFrame([], "repo STRING, pr_id INT, n_symbols BIGINT")
    row = cov.coverage_report(runs, lines, counts).collect()[0]
    assert (row.new_lines_total, row.new_lines_covered) == (0, 0)


def test_summary_text(spark):
    text = cov.summary_text(report(spark, 75.5, 82.3)).collect()[0].summary
    assert text.split("\n") == [
        "Before: 75.50%", "After:  82.30%", "Change: +6.80%", "New lines covered: 140/200", "Target: 80.00% (met)",
    ]


def test_newest_baseline_before_a_run(spark, rows):
    data = [
        (1, "r", at(0), "pr", 10.0), (2, "r", at(1), "baseline", 50.0), (3, "r", at(2), "pr", 55.0),
        (4, "r", at(3), "baseline", 60.0), (5, "r", at(4), "pr", 58.0), (6, "s", at(4), "pr", 1.0),
    ]
    runs = spark.createDataFrame(data, "run_id INT, repo STRING, ts TIMESTAMP_NTZ, kind STRING, pct DOUBLE")
    assert rows(cov.with_baseline(runs), "run_id", "coverage_before") == [(1, None), (3, 50.0), (5, 60.0), (6, None)]
    trend = cov.coverage_trend(runs)
    assert rows(trend, "run_id", "improvement") == [
        (1, None), (2, 40.0), (3, 5.0), (4, 5.0), (5, -2.0), (6, None),
    ]


def test_before_and_after_join(spark, rows):
    schema = "repo STRING, pr_id INT, pct DOUBLE"
    before = spark.createDataFrame([("r", 1, 50.0), ("r", 2, 30.0)], schema)
    after = spark.createDataFrame([("r", 1, 60.0), ("r", 3, 20.0)], schema)
    assert rows(cov.join_before_after(before, after)) == [
        ("r", 1, 50.0, 60.0, 10.0), ("r", 2, 30.0, 30.0, 0.0), ("r", 3, 20.0, 20.0, 0.0),
    ]


GO_LOGS = {
    "coverage: 75.5% of statements": 75.5,
    "ok  \tp\t0.1s\tcoverage: 12% of statements\nok  \tq\t0.1s\tcoverage: 90.0% of statements": 12.0,
    "coverage: none\nx coverage: 1.5e1%": 15.0,
    "nocoverage: 5%": 0.0,
    "coverage:\n7%": 0.0,
    "coverage: 1.5d": 0.0,
    "build failed": 0.0,
    "": 0.0,
}
TOTAL_LOGS = {
    "a.go:1:\tF\t50.0%\ntotal:\t(statements)\t61.2%\n": 61.2,
    "total: x 1%\n  total: y 2%\ntotal: z": 2.0,
    "total: x 1%\ntotal: y none": 1.0,
    "grand total: x 5%": 0.0,
}
SCRIPT_LOGS = {
    "File      | % Stmts |\nAll files |   85.5 |    70 |   90 |   84.25 |\n": 84.25,
    "All files | 1 |": 0.0,
}
PYTHON_LOGS = {"Name Stmts Miss Cover\nTOTAL    120   30   75%\n": 75.0, "a.py 1 0 100%": 0.0}


@pytest.mark.parametrize(
    "reader,logs",
    [
        (src.log_percent_go, GO_LOGS),
        (src.log_percent_go_total, TOTAL_LOGS),
        (src.log_percent_script, SCRIPT_LOGS),
        (src.log_percent_python, PYTHON_LOGS),
    ],
)
def test_log_readers(spark, reader, logs):
    df = spark.createDataFrame([(k,) for k in logs], "log STRING").select("log", reader(F.col("log")).alias("pct"))
    assert {r.log: r.pct for r in df.collect()} == logs


def test_percent_by_project_type(spark, rows):
    go = "ok p coverage: 0.0% of statements\ntotal: (statements) 33.0%"
    data = [("go", go), ("python", "TOTAL 1 1 40%"), ("javascript", "All files | 1 | 1 | 1 | 50 |"), ("unknown", go)]
    df = spark.createDataFrame(data, "kind STRING, log STRING")
    assert rows(df.select("kind", src.log_percent(F.col("log"), F.col("kind")))) == [
        ("go", 33.0), ("javascript", 50.0), ("python", 40.0), ("unknown", None),
    ]


def test_json_reports(spark, rows):
    data = [
        ("cache", '{"coverage": 75.5, "timestamp": "t"}'), ("python", '{"totals": {"percent_covered": 40}}'),
        ("javascript", '{"total": {"lines": {"pct": 50.25}}}'), ("cache", "{}"), ("python", '{"totals": {}}'),
    ]
    df = spark.createDataFrame(data, "tool STRING, body STRING")
    report_ = src.parse_report(F.col("body"))
    assert rows(df.select("tool", src.report_percent(report_, F.col("tool")))) == [
        ("cache", 0.0), ("cache", 75.5), ("javascript", 50.25), ("python", 0.0), ("python", 40.0),
    ]


def test_project_types(spark, rows):
    data = [
        ("a", "go.mod"), ("a", "setup.py"), ("b", "package.json"), ("b", "pyproject.toml"), ("c", "x/go.mod"),
        ("d", "requirements.txt"), ("e", "package.json"), ("e", "setup.py"),
    ]
    files = spark.createDataFrame(data, "repo STRING, path STRING")
    assert rows(cov.project_types(files)) == [
        ("a", "go"), ("b", "python"), ("c", "unknown"), ("d", "unknown"), ("e", "python"),
    ]
    assert rows(cov.project_types(files, fixed.PATH_RULE_MARKERS)) == [
        ("a", "go"), ("b", "javascript"), ("c", "unknown"), ("d", "python"), ("e", "javascript"),
    ]


def test_gates_thresholds_links_and_comment(spark):
    low = report(spark, 80.0, 79.0)
    gate = cov.gates(low, JobConfig(fail_on_decrease=True, min_coverage_increase=0.5)).collect()[0]
    assert not gate.decrease_ok and not gate.increase_ok
    assert cov.gates(low).collect()[0].decrease_ok
    thresholds = spark.createDataFrame([("r", 70.0)], "repo STRING, threshold DOUBLE")
    assert cov.with_thresholds(low, thresholds).collect()[0].target_met
    assert not cov.with_thresholds(low, thresholds.limit(0)).collect()[0].target_met
    links = spark.createDataFrame([("r", 1, 456)], "repo STRING, pr_id INT, linked_pr INT")
    assert cov.with_linked_request(low, links).collect()[0].link_line == "Functional tests: #456"
    assert cov.with_linked_request(low, links.limit(0)).collect()[0].link_line == "No functional tests"
    counted = low.withColumns({"unit_count": F.lit(8), "functional_count": F.lit(2)})
    assert cov.comment_body(counted).collect()[0].body == (
        "Unit tests: 8\nFunctional tests: 2\nCoverage: 80.00% to 79.00% (-1.00%)"
    )


def test_rollup_and_retries(spark, rows):
    changes = spark.createDataFrame(
        [("r", "a/x", 1), ("r", "b/x", 2), ("s", "x", 4)], "repo STRING, path STRING, lines_changed INT"
    )
    found = rows(cov.change_rollup(changes), "repo", "module", "n_files", "lines_changed")
    assert ("", "", 3, 7) in found and ("r", "", 2, 3) in found and ("r", "a", 1, 1) in found
    data = [("a", True), ("a", True), ("b", True), ("b", False), ("c", True), ("c", True), ("c", True), ("d", False)]
    attempts = spark.createDataFrame(data, "request_id STRING, failed BOOLEAN")
    assert rows(cov.request_retries(attempts), "request_id", "n_failed", "may_retry") == [
        ("a", 2, True), ("b", 1, False), ("c", 3, False), ("d", 0, False),
    ]


def test_run_summary_keeps_runs_without_integration(spark, rows):
    generation = spark.createDataFrame([("r", 1, 5), ("r", 2, 6)], "repo STRING, pr_id INT, total_test_cases INT")
    integration = spark.createDataFrame(
        [("r", 1, 2, 1, 4)],
        "repo STRING, pr_id INT, files_integrated INT, duplicates_skipped INT, tests_added INT",
    )
    requests = spark.createDataFrame([("r", 1, "url")], "repo STRING, pr_id INT, pr_url STRING")
    assert rows(cov.run_summary(generation, integration, requests)) == [
        ("r", 1, 5, 2, 1, 4, "url"), ("r", 2, 6, 0, 0, 0, None),
    ]


def test_metrics(spark, rows):
    plan = spark.createDataFrame(
        [("r", 1, "a"), ("r", 1, "a"), ("r", 1, "b"), ("s", 2, "a")], "repo STRING, pr_id INT, test_path STRING"
    )
    assert rows(cov.tests_per_request(plan), "repo", "pr_id", "n_cases", "n_test_files") == [
        ("", "", 4, 3), ("r", "", 3, 2), ("r", "1", 3, 2), ("s", "", 1, 1), ("s", "2", 1, 1),
    ]
    attempts = spark.createDataFrame(
        [("r", 2, False), ("r", 4, True)], "repo STRING, duration INT, failed BOOLEAN"
    )
    assert rows(cov.generation_metrics(attempts)) == [("r", 2, 3.0, 0.5)]


def test_log_files(spark, rows, tmp_path):
    folder = tmp_path / "repo=r" / "run_id=7"
    folder.mkdir(parents=True)
    (folder / "log.txt").write_text("ok p coverage: 12.5% of statements\nmore\n")
    logs = src.read_logs(spark, str(tmp_path))
    assert rows(logs.select("repo", "run_id", src.log_percent_go(F.col("log")))) == [("r", 7, 12.5)]
