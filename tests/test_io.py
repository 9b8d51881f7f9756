import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from changelens import session
from changelens.config import JobConfig
from changelens.functions import text
from changelens.operators import responses as rs
from changelens.sources import changes as src_changes
from changelens.sources import code, sinks
from changelens.sources import coverage as src_cov
from changelens.sources.responses import fenced_code
from changelens.streaming import pr_events as stream


def test_source_directory(spark, rows, tmp_path):
    (tmp_path / "root/src").mkdir(parents=True)
    (tmp_path / "root/test dir").mkdir()
    texts = {"src/a.go": "package a\n\nfunc A() {}\n", "test dir/test_x+y.py": "def test_x():\n\n", "src/empty.py": ""}
    for name, body in texts.items():
        (tmp_path / "root" / name).write_text(body)
    root = str(tmp_path / "root")
    found = rows(code.read_source_files(spark, root), "path", "content")
    assert [r for r in found if r[1]] == sorted((k, v) for k, v in texts.items() if v)
    assert rows(code.read_source_files(spark, root, "*.go"), "path") == [("src/a.go",)]
    assert rows(code.read_test_files(spark, root), "path") == [("test dir/test_x+y.py",)]


def test_code_table_round_trip(spark, rows, tmp_path):
    files = spark.createDataFrame([("r1", "a", "x\ny"), ("r2", "b", "")], code.CODE_SCHEMA)
    out = str(tmp_path / "t")
    code.write_code_table(files, out)
    assert rows(code.read_code_table(spark, out)) == rows(files)


def test_test_file_sink_replaces_only_its_repositories(spark, rows, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_test_files(spark.createDataFrame([("r1", "a", "1"), ("r2", "b", "2")], code.CODE_SCHEMA), out)
    sinks.write_test_files(spark.createDataFrame([("r1", "c", "3")], code.CODE_SCHEMA), out)
    assert rows(code.read_code_table(spark, out)) == [("r1", "c", "3"), ("r2", "b", "2")]


def test_functional_files_are_published(spark, rows, tmp_path):
    files = spark.createDataFrame([("r", "x/test_A_functional.go", "1"), ("r", "functional/a_test.go", "2")], code.CODE_SCHEMA)
    out = str(tmp_path / "t")
    assert sinks.has_functional_files(files)
    assert not sinks.has_functional_files(files.where("content = '2'"))
    sinks.publish_functional_files(files, out)
    assert rows(code.read_code_table(spark, out), "path") == [("tests/auto-generated/test_A_functional.go",)]


def test_functional_files_of_two_requests_stay_apart(spark, rows, tmp_path):
    files = spark.createDataFrame(
        [("r", 1, "x/test_A_functional.go", "1"), ("r", 2, "y/test_A_functional.go", "2")], "repo STRING, pr_id LONG, path STRING, content STRING"
    )
    out = str(tmp_path / "t")
    sinks.publish_functional_files(files, out)
    assert rows(code.read_code_table(spark, out), "path", "content") == [
        ("tests/auto-generated/1/test_A_functional.go", "1"), ("tests/auto-generated/2/test_A_functional.go", "2")
    ]


def test_json_report_and_display(spark, rows, tmp_path):
    shown = spark.createDataFrame(
        [("r", 1.5, 2.5, 1.0, 80.0, False)],
        "repo STRING, coverage_before DOUBLE, coverage_after DOUBLE, coverage_delta DOUBLE, "
        "coverage_target DOUBLE, target_met BOOLEAN",
    )
    out = str(tmp_path / "t")
    sinks.write_json_report(shown, out)
    parsed = spark.read.text(out).select(src_cov.parse_summary(F.col("value")).alias("r")).select("r.*")
    assert rows(parsed) == [(1.5, 2.5, 1.0, 80.0, False)]


def test_json_report_scan_over_lines(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"totals": {"percent_covered": 40.5}}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"coverage": 7.0}, indent=2))
    found = src_cov.read_json_reports(spark, str(tmp_path))
    assert rows(found, "coverage", "totals.percent_covered") == [(7.0, None), (None, 40.5)]


def test_change_lines_scan(spark, rows, tmp_path):
    (tmp_path / "repo=r1").mkdir()
    (tmp_path / "repo=r1/list.txt").write_text("M\ta.go\n\nA\tb.go\n")
    lines = src_changes.parse_change_lines(src_changes.read_change_lines(spark, str(tmp_path)))
    assert rows(lines, "repo", "status", "path") == [("r1", "A", "b.go"), ("r1", "M", "a.go")]


def test_baselines_are_appended(spark, tmp_path):
    out = str(tmp_path / "t")
    for value in (1.0, 2.0):
        rows_ = spark.createDataFrame([("r", dt.datetime(2026, 1, int(value)), 7, value)], "repo STRING, ts TIMESTAMP_NTZ, run_id LONG, coverage DOUBLE")
        sinks.append_baselines(rows_, out)
    assert spark.read.parquet(out).count() == 2
    tied = spark.createDataFrame([("r", dt.datetime(2026, 1, 2), 9, 0.5)], rows_.schema)
    sinks.append_baselines(tied, out)
    assert sinks.newest_baselines(spark.read.parquet(out)).collect()[0]["coverage"] == 0.5


BODY = json.dumps(
    {
        "id": "m", "role": "assistant",
        "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "a\n```go\nx\n```\n"},
                    {"type": "text", "text": "```\ny\nz\n```"}],
        "usage": {"input_tokens": 3, "output_tokens": 5},
    }
)


def test_responses(spark, rows):
    df = spark.createDataFrame([("r", BODY), ("r", BODY), ("s", "{}")], "repo STRING, body STRING")
    found = rs.response_texts(df).where("repo = 'r'").collect()[0]
    assert found.answer == "a\n```go\nx\n```\n```\ny\nz\n```"
    assert found.first_answer == "hm"
    assert found.code == "x\ny\nz"
    assert rs.response_texts(df).where("repo = 's'").collect()[0].answer == ""
    assert rows(rs.token_totals(df.where("repo = 'r'"), ("repo",))) == [("r", 2, 6, 10)]


def test_long_fenced_code_is_kept_whole(spark):
    body = "x\n" * 100000
    df = spark.createDataFrame([(f"start\n```go\n{body}```\nend",)], "r STRING")
    assert df.select(fenced_code(F.col("r"))).collect()[0][0] == body[:-1]


def test_cached_answers(spark, rows):
    def at(hour):
        return dt.datetime(2026, 1, 1) + dt.timedelta(hours=hour)

    asked = spark.createDataFrame(
        [(1, at(0), "p"), (2, at(2), "p"), (3, at(25), "p"), (4, at(26), "p"), (5, at(2), "q"), (6, at(1), "p")],
        "request_id INT, ts TIMESTAMP_NTZ, prompt STRING",
    )
    answered = spark.createDataFrame(
        [(10, at(1), "p", "one")], "request_id INT, ts TIMESTAMP_NTZ, prompt STRING, answer STRING"
    )
    assert rows(rs.cached_answers(asked, answered), "request_id", "is_hit", "answer") == [
        (1, False, None), (2, True, "one"), (3, True, "one"), (4, False, None), (5, False, None), (6, True, "one"),
    ]
    assert rows(rs.cached_answers(asked, answered, JobConfig(cache_hours=1)).where("is_hit"), "request_id") == [(2,), (6,)]


def test_clone_address(spark):
    data = {
        " git@host.example:owner/name.git\n": "https://host.example/owner/name.git",
        "https://host.example/a:b": "https://host.example/a:b",
    }
    df = spark.createDataFrame([(k,) for k in data], "u STRING").select("u", text.https_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == data


def test_text_expressions(spark):
    df = spark.createDataFrame([("  aB\tc  ",)], "t STRING")
    t = F.col("t")
    row = df.select(
        text.trim_space(t), text.fields(t), text.field(t, 5), text.capitalize(F.lit("fooBAR")), text.capitalize(F.lit("")),
        text.trim_suffix(F.lit("x.go"), ".go"), text.trim_prefix(F.lit("x.go"), "x."), text.number(F.lit("1.5f")),
        text.number(F.lit("-2e1")), text.percent(F.lit("7.5%")), text.newline_count(F.lit("a\n\nb")),
        text.fill("{a}{b}{a}", a=F.lit("1"), b=F.lit("2")),
    ).collect()[0]
    assert tuple(row) == ("aB\tc", ["aB", "c"], None, "FooBAR", "", "x", "go", None, -20.0, 7.5, 2, "121")


def test_events_start_one_run_each(spark, rows, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "event_id BIGINT, ts TIMESTAMP, kind STRING"
    first = [(1, dt.datetime(2026, 1, 1, 0, 0), "opened"), (1, dt.datetime(2026, 1, 1, 0, 5), "opened"),
             (2, dt.datetime(2026, 1, 1, 0, 1), "closed"), (3, dt.datetime(2026, 1, 1, 0, 2), "reopened")]
    second = [(1, dt.datetime(2026, 1, 1, 0, 20), "synchronize"), (4, dt.datetime(2026, 1, 1, 0, 30), "synchronize")]
    for batch in (first, second):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        events = stream.read_events(spark, src, schema)
        stream.start_runs(stream.run_requests(events), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id", "kind") == [(1, "opened"), (3, "reopened"), (4, "synchronize")]


def test_shared_folder_comes_from_the_session(spark):
    folder = session.shared_dir(spark)
    assert session.work_path(spark, "x").startswith(folder)
    assert session.work_path(spark, "x") != session.work_path(spark, "x")


@pytest.mark.parametrize("globs,path,hit", [
    (["*.go"], "a/b.go", True), (["*.go"], "a/b.gox", False), (["vendor/*"], "vendor/a", True),
    (["vendor/*"], "x/vendor/a", True), (["vendor/*"], "myvendor/a", False), (["test_?.py"], "x/test_a.py", True),
    ([".git/*"], "xgit/a", False),
])
def test_globs(globs, path, hit):
    import re

    assert bool(re.search(text.glob_regex(globs), path)) is hit


def test_fences_that_are_empty_indented_or_cut_off(spark):
    answers = [
        "a\n```go\nx := 1\n```\nb\n```\ny\n```\n",
        "```\n```\nprose\n```go\ncode()\n```\n",
        "list\n  ```py\n  f()\n  ```\n",
        "cut\n```go\nfunc f() {\n\treturn",
        "no code, only ``` inside a line",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "i INT, r STRING").orderBy("i")
    found = [r[0] for r in df.select(fenced_code(F.col("r"))).collect()]
    assert found == ["x := 1\ny", "\ncode()", "  f()", "func f() {\n\treturn", ""]
