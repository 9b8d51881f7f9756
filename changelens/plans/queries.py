"""The driver's queries: derived tables put through the operators.

Long texts are returned as digests; the digest covers the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import fixed, paths, text
from changelens.operators import changes as ch
from changelens.operators import coverage as cov
from changelens.operators import covered
from changelens.operators import dedup as dd
from changelens.operators import hunks
from changelens.operators import responses as rs
from changelens.operators import reach, renames, rules
from changelens.operators import symbols as sy
from changelens.operators import testplan as tp
from changelens.plans import runs
from changelens.plans.views import Views
from changelens.session import work_path
from changelens.sources import changes as src_changes
from changelens.sources import code as src_code
from changelens.sources import coverage as src_cov
from changelens.sources import profiles
from changelens.sources import sinks, smallfiles, versions
from changelens.streaming import pr_events as stream
from changelens.streaming import requests

Query = Callable[[Views], DataFrame]
REGISTRY: dict[str, Query] = {}
CONFIG = JobConfig()
REPO = ("repo",)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _joined(names: str | Column) -> Column:
    return F.array_join(names, ",")


def _big(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("bigint")


def _ts(name: str = "ts") -> Column:
    return F.col(name).cast("string").alias(name)


def _changes(v: Views) -> DataFrame:
    return src_changes.parse_change_lines(v.name_status())


def _analysis(v: Views) -> runs.ChangeAnalysis:
    return runs.ChangeAnalysis(_changes(v).drop("doc_id"), v.code_files(), CONFIG)


# Changes


@query
def change_report(v: Views) -> DataFrame:
    return ch.change_report(v.base_files(), v.head_files())


@query
def snapshot_status(v: Views) -> DataFrame:
    return ch.diff_snapshots(v.base_files(), v.head_files())


@query
def snapshot_lines(v: Views) -> DataFrame:
    return ch.line_changes(v.base_files(), v.head_files())


@query
def snapshot_hunks(v: Views) -> DataFrame:
    return hunks.line_hunks(v.base_files(), v.head_files())


@query
def hunk_line_counts(v: Views) -> DataFrame:
    return hunks.hunk_lines(hunks.line_hunks(v.base_files(), v.head_files()))


@query
def snapshot_renames(v: Views) -> DataFrame:
    return renames.snapshot_renames(v.base_files(), v.moved_files(), copies=True)


@query
def covered_lines(v: Views) -> DataFrame:
    """New lines of the head snapshot that the coverage profiles of three tools say ran."""
    changed = covered.hunk_ranges(hunks.line_hunks(v.base_files(), v.head_files()))
    return covered.covered_lines(changed, profiles.profile_ranges(v.line_profiles(), REPO))


@query
def request_coverage(v: Views) -> DataFrame:
    return _analysis(v).covered_lines(v.patches(), profiles.profile_ranges(v.line_profiles(), ch.KEYS))


@query
def name_status_files(v: Views) -> DataFrame:
    return ch.routed(_changes(v)).select("doc_id", "repo", "status", "status_class", "path")


@query
def change_list_scan(v: Views) -> DataFrame:
    """Change lists written as text, scanned again and parsed."""
    out = work_path(v.spark, "change-lists")
    v.name_status().select("repo", F.col("line").alias("value")).hint("rebalance", "repo").write.partitionBy(
        "repo"
    ).text(out)
    rows = src_changes.parse_change_lines(src_changes.read_change_lines(v.spark, out))
    return rows.select(F.col("repo").cast("string").alias("repo"), "status", "path")


@query
def changed_file_counts(v: Views) -> DataFrame:
    return ch.file_counts(_changes(v))


@query
def patch_lines(v: Views) -> DataFrame:
    return _analysis(v).file_changes(v.patches()).select(
        "repo", "pr_id", "path", "status", "language",
        _big("lines_changed").alias("lines_changed"),
        _big("lines_added").alias("lines_added"),
        F.md5("diff").alias("diff_md5"),
    )


@query
def status_counts(v: Views) -> DataFrame:
    return ch.status_counts(v.pr_files())


@query
def new_lines(v: Views) -> DataFrame:
    return ch.new_lines(v.pr_files())


@query
def languages(v: Views) -> DataFrame:
    path = F.col("path")
    return v.code_files().select("path", paths.language(path).alias("language"))


@query
def languages_short(v: Views) -> DataFrame:
    language = paths.test_language(F.col("path"))
    return v.code_files().select(
        "path", language.alias("language"), paths.language_extension(language).alias("extension")
    )


@query
def languages_display(v: Views) -> DataFrame:
    return v.code_files().select("path", paths.display_language(F.col("path")).alias("language"))


@query
def analyzable_files(v: Views) -> DataFrame:
    return ch.analyzable_files(ch.modified_files(_changes(v))).select("doc_id", "path")


@query
def modules(v: Views) -> DataFrame:
    return ch.affected_modules(v.code_files(), REPO)


@query
def preview_files(v: Views) -> DataFrame:
    order = ["seq", "path", "status", "lines_changed"]
    return ch.preview(v.pr_files(), order, CONFIG.preview_files).select(
        "repo", "pr_id", _big("rank").alias("rank"), "path", "status", "n_more"
    )


# Symbols


def _symbols_of(v: Views, *languages: str) -> DataFrame:
    return sy.symbols(v.code_files()).where(F.col("language").isin(*languages))


@query
def py_functions(v: Views) -> DataFrame:
    return sy.functions(_symbols_of(v, "python")).select("repo", "path", "name")


@query
def py_classes(v: Views) -> DataFrame:
    return sy.classes(_symbols_of(v, "python")).select("repo", "path", "name")


@query
def js_functions(v: Views) -> DataFrame:
    return sy.functions(_symbols_of(v, "javascript", "typescript")).select("repo", "path", "language", "name")


@query
def js_classes(v: Views) -> DataFrame:
    return sy.classes(_symbols_of(v, "javascript", "typescript")).select("repo", "path", "language", "name")


@query
def go_functions(v: Views) -> DataFrame:
    return sy.functions(_symbols_of(v, "go")).select("repo", "path", "name", _big("line").alias("line"))


@query
def go_args(v: Views) -> DataFrame:
    rows = sy.functions(_symbols_of(v, "go"))
    return rows.select("path", F.col("name").alias("function"), F.posexplode("args")).select(
        "path", "function", _big("pos").alias("pos"), F.col("col").alias("arg")
    )


@query
def go_structs(v: Views) -> DataFrame:
    return sy.classes(_symbols_of(v, "go")).select("repo", "path", "name", _big("line").alias("line"))


@query
def struct_methods(v: Views) -> DataFrame:
    rows = sy.classes(_symbols_of(v, "go"))
    return rows.select("path", "name", _joined("methods").alias("methods"))


@query
def nested_declarations(v: Views) -> DataFrame:
    """Grouped types, headers over several lines, function-typed parameters, local types."""
    return sy.symbols(v.nested_sources()).select(
        "doc_id", "kind", "name", _big("line").alias("line"), _joined("args").alias("args"), _joined("methods").alias("methods")
    )


@query
def symbols_all(v: Views) -> DataFrame:
    return sy.symbols(v.code_files()).select(
        "repo", "pr_id", "path", "language", "kind", "type", "name",
        _big("line").alias("line"), _joined("args").alias("args"), _joined("methods").alias("methods"),
        _big("ord").alias("ord"),
    )


@query
def semantic_changes(v: Views) -> DataFrame:
    return _analysis(v).semantic_changes


@query
def high_impact(v: Views) -> DataFrame:
    return sy.high_impact(_analysis(v).semantic_changes)


@query
def symbol_frameworks(v: Views) -> DataFrame:
    frameworks = {**CONFIG.frameworks, **fixed.EXTRA_FRAMEWORKS}
    return sy.with_framework(sy.symbols(v.code_files()), frameworks).select(
        "path", "kind", "name", "language", "framework"
    )


@query
def file_frameworks(v: Views) -> DataFrame:
    """The table form of the framework lookup, over all files."""
    table = v.spark.createDataFrame(
        list({**CONFIG.frameworks, **fixed.EXTRA_FRAMEWORKS}.items()), "language STRING, framework STRING"
    )
    files = v.code_files().select("path", paths.language(F.col("path")).alias("language"))
    return sy.with_framework_table(files, table).select("path", "language", "framework")


@query
def symbol_sources(v: Views) -> DataFrame:
    found = sy.symbols(v.code_files()).select("repo", "path", "kind", "name")
    return sy.with_source(found, v.code_files()).select(
        "repo", "path", "kind", "name", F.md5("content").alias("source_md5")
    )


# Test planning


@query
def test_plan(v: Views) -> DataFrame:
    plan = _analysis(v).test_plan()
    return plan.select(
        "repo", "pr_id", F.coalesce("path", F.lit("")).alias("path"), "symbol", "name",
        "description", "case_type", "test_path", F.md5("code").alias("code_md5"),
    )


@query
def test_plan_no_edges(v: Views) -> DataFrame:
    config = JobConfig(generate_edge_cases=False)
    return tp.unit_cases(sy.symbols(v.code_files()), config).select("path", "symbol", "name", "case_type")


@query
def test_plan_stats(v: Views) -> DataFrame:
    return _analysis(v).generation_stats()


@query
def test_paths_flat(v: Views) -> DataFrame:
    path = F.col("path")
    language = paths.language(path)
    module = F.coalesce(paths.module(path), F.lit("root"))
    return v.code_files().select(
        "path",
        paths.flat_test_name(path, language).alias("unit_name"),
        paths.functional_test_name(paths.stem(path), paths.test_language(path)).alias("functional_name"),
        paths.integration_test_name(module).alias("integration_name"),
    )


@query
def test_paths_beside(v: Views) -> DataFrame:
    path = F.col("path")
    return v.code_files().select(
        "path",
        paths.test_path_beside(path).alias("unit_path"),
        paths.test_path_beside(path, "functional").alias("functional_path"),
    )


@query
def test_files(v: Views) -> DataFrame:
    return tp.unit_test_files(v.code_files(), CONFIG).select(
        "repo", "pr_id", "path", "test_path", _big("n_cases").alias("n_cases"),
        F.md5("content").alias("content_md5"),
    )


@query
def test_files_last_writer(v: Views) -> DataFrame:
    return tp.unit_test_files_last_writer(v.code_files(), CONFIG, REPO).select(
        "repo", "test_path", "symbol", _big("n_cases").alias("n_cases"),
        F.md5("content").alias("content_md5"),
    )


@query
def single_case_files(v: Views) -> DataFrame:
    analysis = _analysis(v)
    cases = tp.functional_cases(analysis.semantic_changes).unionByName(
        tp.integration_cases(analysis.modules), allowMissingColumns=True
    )
    return tp.single_case_files(cases).select(
        "repo", "pr_id", "test_path", F.md5("content").alias("content_md5")
    )


@query
def prompts(v: Views) -> DataFrame:
    rows = tp.function_prompts(sy.symbols(v.code_files(), keep_content=True))
    return rows.select("repo", "path", "name", F.md5("prompt").alias("prompt_md5"))


@query
def file_prompts(v: Views) -> DataFrame:
    return tp.file_prompts(v.code_files(), "unit").select("repo", "path", F.md5("prompt").alias("prompt_md5"))


@query
def path_rules(v: Views) -> DataFrame:
    return tp.path_rules(v.code_files()).select("repo", "path", "wants_functional")


@query
def page_path_rules(v: Views) -> DataFrame:
    """Path rules over the paths of page addresses, most of which have no extension."""
    pages = v.table("pages").select(
        "page_id", F.regexp_replace("url", r"^https?://[^/]*/", "").alias("path")
    )
    return tp.path_rules(pages).select("page_id", "path", "wants_functional")


@query
def names_by_pattern(v: Views) -> DataFrame:
    return tp.names_by_pattern(sy.symbols(v.code_files()), CONFIG).select(
        "path", "kind", "name", "unit_name", "functional_name"
    )


# Test files and deduplication


def _suite_paths(v: Views) -> DataFrame:
    """Sources, unit test paths and functional test names of all code files."""
    path = F.col("path")
    return v.code_files().select(
        "repo",
        F.explode(
            F.array(
                path,
                paths.test_path_beside(path),
                paths.functional_test_name(paths.stem(path), paths.test_language(path)),
            )
        ).alias("path"),
    )


@query
def test_file_filter(v: Views) -> DataFrame:
    return _suite_paths(v).where(paths.is_test_file(F.col("path")))


@query
def functional_files(v: Views) -> DataFrame:
    return sinks.functional_files(_suite_paths(v))


@query
def test_file_count(v: Views) -> DataFrame:
    path = F.col("path")
    return _suite_paths(v).groupBy("repo").agg(
        F.count_if(paths.matches_test_globs(path)).alias("n_test_files"),
        F.count_if(paths.mentions_test(path)).alias("n_mentioning_test"),
    )


@query
def test_names(v: Views) -> DataFrame:
    return dd.exploded_names(v.existing_tests())


@query
def test_blocks(v: Views) -> DataFrame:
    return dd.exploded_blocks(v.existing_tests()).select(
        "repo", "path", _big("block_no").alias("block_no"), "test_name", F.md5("block").alias("block_md5")
    )


@query
def test_blocks_unindented(v: Views) -> DataFrame:
    return dd.exploded_blocks(v.existing_tests(), unindented=True).select(
        "repo", "path", _big("block_no").alias("block_no"), "test_name", F.md5("block").alias("block_md5")
    )


@query
def matched_paths(v: Views) -> DataFrame:
    return dd.matched_paths(v.generated_files(), v.existing_tests())


@query
def duplicate_files(v: Views) -> DataFrame:
    return dd.duplicate_files(v.generated_files(), v.existing_tests())


@query
def new_tests(v: Views) -> DataFrame:
    return dd.new_tests(v.generated_tests(), v.existing_tests()).select("repo", "path", "name")


@query
def new_tests_exact(v: Views) -> DataFrame:
    return dd.new_tests_exact(v.generated_tests(), v.existing_tests()).select("repo", "path", "name")


@query
def test_name_difference(v: Views) -> DataFrame:
    return dd.test_name_difference(v.generated_tests(), v.existing_tests())


@query
def integration_stats(v: Views) -> DataFrame:
    return dd.integration_stats(v.generated_files(), v.existing_tests())


def _digested(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", "action", F.md5("content").alias("content_md5"))


@query
def merged_files(v: Views) -> DataFrame:
    return _digested(dd.integrate_files(v.generated_files(), v.existing_tests()))


@query
def merged_files_per_test(v: Views) -> DataFrame:
    return _digested(dd.integrate_files(v.generated_files(), v.existing_tests(), per_test=True))


@query
def obsolete_tests(v: Views) -> DataFrame:
    names = dd.exploded_names(v.existing_tests()).select("repo", "test_name")
    return dd.obsolete_tests(names, sy.symbols(v.head_files())).select("repo", "test_name")


@query
def unreached_tests(v: Views) -> DataFrame:
    """Tests that reach no symbol of the head snapshot, also not through helper functions."""
    return reach.unreached_tests(v.helper_tests(), sy.symbols(v.head_files()))


@query
def run_summary(v: Views) -> DataFrame:
    keys = REPO
    changes = _changes(v)
    found = runs.modified_symbols(changes, v.code_files(), CONFIG, keys)
    generation = tp.generation_stats(changes, found, CONFIG, keys)
    integration = dd.integration_stats(v.generated_files(), v.existing_tests())
    latest = v.pull_requests().groupBy("repo").agg(
        F.max_by("pr_url", F.struct("created_at", "pr_id")).alias("pr_url")
    )
    return cov.run_summary(generation, integration, latest, keys)


# Coverage


@query
def coverage_from_log(v: Views) -> DataFrame:
    return v.coverage_logs().select("run_id", src_cov.log_percent_go(F.col("go_log")).alias("pct"))


@query
def coverage_total(v: Views) -> DataFrame:
    return v.coverage_logs().select("run_id", src_cov.log_percent_go_total(F.col("go_log")).alias("pct"))


@query
def coverage_js(v: Views) -> DataFrame:
    return v.coverage_logs().select("run_id", src_cov.log_percent_script(F.col("js_log")).alias("pct"))


@query
def coverage_py(v: Views) -> DataFrame:
    return v.coverage_logs().select("run_id", src_cov.log_percent_python(F.col("py_log")).alias("pct"))


def _type_percent() -> Column:
    kind = F.col("project_type")
    log = F.when(kind == "python", F.col("py_log")).when(kind == "javascript", F.col("js_log")).otherwise(
        F.col("go_log")
    )
    return src_cov.log_percent(log, kind)


@query
def coverage_by_type(v: Views) -> DataFrame:
    return v.coverage_logs().select(
        "run_id", "project_type", F.coalesce(_type_percent(), F.lit(-1.0)).alias("pct")
    )


@query
def coverage_from_json(v: Views) -> DataFrame:
    report = src_cov.parse_report(F.col("body"))
    return v.coverage_json().select(
        "run_id", "tool", src_cov.report_percent(report, F.col("tool")).alias("pct")
    )


@query
def coverage_json_scan(v: Views) -> DataFrame:
    """JSON reports written as text files, scanned with the report schema."""
    out = work_path(v.spark, "json-reports")
    v.coverage_json().select("tool", F.col("body").alias("value")).write.partitionBy("tool").text(out)
    report = v.spark.read.schema(src_cov.REPORT_SCHEMA + ", tool STRING").json(out)
    pct = src_cov.report_percent(F.struct("coverage", "totals", "total"), F.col("tool"))
    return report.select("tool", pct.alias("pct")).groupBy("tool", "pct").agg(F.count("*").alias("n_reports"))


@query
def project_type(v: Views) -> DataFrame:
    by_marker = cov.project_types(v.root_files())
    by_rules = cov.project_types(v.root_files(), fixed.PATH_RULE_MARKERS)
    return by_marker.join(by_rules.withColumnRenamed("project_type", "project_type_by_rules"), "repo")


@query
def coverage_baseline(v: Views) -> DataFrame:
    runs_ = v.coverage_runs().select("run_id", "repo_key", "ts", "kind", "pct")
    return cov.with_baseline(runs_, "repo_key").select(
        "run_id", "repo_key", F.coalesce("coverage_before", F.lit(0.0)).alias("coverage_before")
    )


def _report(v: Views) -> DataFrame:
    runs_ = cov.with_baseline(
        v.coverage_runs().select("run_id", "pr_id", "repo", "repo_key", "ts", "kind", "pct"), "repo_key"
    )
    return cov.coverage_report(runs_, ch.new_lines(v.pr_files()), _analysis(v).symbol_counts(), CONFIG)


@query
def coverage_report(v: Views) -> DataFrame:
    return _report(v).withColumn("ts", F.col("ts").cast("string"))


@query
def before_after(v: Views) -> DataFrame:
    logs = v.coverage_logs().select("repo", "pr_id", "kind", _type_percent().alias("pct"))
    before = logs.where(F.col("kind") == "baseline").select("repo", "pr_id", "pct")
    after = v.coverage_json().select(
        F.concat(F.lit("repo"), (F.col("run_id") % 10).cast("string")).alias("repo"),
        F.col("run_id").alias("pr_id"),
        src_cov.report_percent(src_cov.parse_report(F.col("body")), F.col("tool")).alias("pct"),
    )
    return cov.join_before_after(before, after)


@query
def coverage_summary(v: Views) -> DataFrame:
    links = v.pull_requests().select("repo", "pr_id", (F.col("pr_id") + 1).alias("linked_pr"))
    rows = cov.with_linked_request(cov.summary_text(_report(v)), links)
    return rows.select("repo", "pr_id", "summary", "link_line")


@query
def gates(v: Views) -> DataFrame:
    config = JobConfig(fail_on_decrease=True, min_coverage_increase=1.0)
    return cov.gates(_report(v), config).select(
        "repo", "pr_id", "decrease_ok", "increase_ok", F.round("shortfall", 4).alias("shortfall")
    )


@query
def project_thresholds(v: Views) -> DataFrame:
    thresholds = v.pull_requests().groupBy("repo").agg(
        (F.lit(60.0) + F.max("pr_id") % 30).alias("threshold")
    )
    return cov.with_thresholds(_report(v), thresholds, CONFIG).select(
        "repo", "pr_id", "coverage_target", "target_met"
    )


@query
def comment_body(v: Views) -> DataFrame:
    counts = _analysis(v).generation_stats().select(
        "repo", "pr_id",
        F.col("unit_tests_generated").alias("unit_count"),
        F.col("functional_tests_generated").alias("functional_count"),
    )
    counted = _report(v).join(counts, ["repo", "pr_id"], "left").fillna(0, ["unit_count", "functional_count"])
    return cov.comment_body(counted).select("repo", "pr_id", "body")


@query
def metrics_rollup(v: Views) -> DataFrame:
    return cov.change_rollup(v.pr_files()).withColumn("level", _big("level"))


@query
def tests_per_request(v: Views) -> DataFrame:
    return cov.tests_per_request(_analysis(v).test_plan()).withColumn("level", _big("level"))


@query
def generation_metrics(v: Views) -> DataFrame:
    attempts = v.table("events").select(
        F.col("user_id").alias("repo_key"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return cov.generation_metrics(attempts, ("repo_key",))


@query
def coverage_trend(v: Views) -> DataFrame:
    rows = cov.coverage_trend(v.coverage_runs(), "repo_key")
    return rows.select("repo_key", "run_id", F.coalesce(F.round("improvement", 4), F.lit(0.0)).alias("improvement"))


# Rules


@query
def generation_rules(v: Views) -> DataFrame:
    changed = rules.included(rules.large_enough(v.pr_files(), CONFIG), CONFIG)
    return changed.select("repo", "pr_id", _big("seq").alias("seq"), "path", _big("lines_changed").alias("lines_changed"))


@query
def capped_cases(v: Views) -> DataFrame:
    config = JobConfig(max_tests_per_function=2)
    return tp.unit_cases(sy.symbols(v.code_files()), config, cap=True).select("path", "symbol", "name")


# Responses


@query
def response_text(v: Views) -> DataFrame:
    return rs.response_texts(v.model_responses()).select("conv_id", "turn", "answer", "first_answer")


@query
def response_code(v: Views) -> DataFrame:
    return rs.response_texts(v.model_responses()).select("conv_id", "turn", "code")


@query
def fenced_documents(v: Views) -> DataFrame:
    return v.fenced_answers().select("doc_id", F.md5(rs.fenced_code(F.col("r"))).alias("code_md5"))


@query
def response_tokens(v: Views) -> DataFrame:
    return rs.token_totals(v.model_responses(), REPO)


@query
def enhanced_cases(v: Views) -> DataFrame:
    """The first answer of a conversation as one more case of the function of that number."""
    cases = tp.unit_cases(sy.symbols(v.code_files()))
    first = rs.response_texts(v.model_responses()).groupBy("conv_id").agg(
        F.min_by("answer", "turn").alias("answer")
    )
    named = first.select(
        F.concat(F.lit("load_"), F.col("conv_id").cast("string")).alias("symbol"), "answer"
    )
    functions_ = sy.functions(sy.symbols(v.code_files())).select(
        "repo", "pr_id", "path", F.col("name").alias("symbol")
    )
    stored = functions_.join(named, "symbol")
    return tp.enhanced_cases(cases, stored).select(
        "repo", "pr_id", "path", "name", "description", "case_type", F.md5("code").alias("code_md5")
    )


@query
def response_cache(v: Views) -> DataFrame:
    """Views ask, purchases answer; the prompt is the event's property text."""
    events = v.table("events")
    asked = events.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("request_id"), "ts", F.col("props").alias("prompt")
    )
    answered = events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("request_id"), "ts", F.col("props").alias("prompt"),
        F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
    )
    found = rs.cached_answers(asked, answered, CONFIG)
    return found.select("request_id", "is_hit", F.coalesce("answer", F.lit("")).alias("answer"))


@query
def retries(v: Views) -> DataFrame:
    attempts = v.table("events").select(
        F.col("user_id").alias("request_id"), (F.col("event_type") == "error").alias("failed")
    )
    return cov.request_retries(attempts, CONFIG)


# Scalars


@query
def repo_urls(v: Views) -> DataFrame:
    url = F.col("url")
    ssh = F.concat(
        F.lit(" git@"), F.regexp_extract(url, r"^https?://([^/]+)/", 1), F.lit(":"),
        F.regexp_replace(url, r"^https?://[^/]+/", ""), F.lit("\n"),
    )
    return v.table("pages").select(
        "page_id", text.https_url(url).alias("https_url"), text.https_url(ssh).alias("from_ssh")
    )


@query
def scalar_strings(v: Views) -> DataFrame:
    path = F.col("path")
    line = F.substring_index("content", "\n", 1)
    return v.code_files().where(text.trim_space(line) != "").select(
        "doc_id",
        text.capitalize(paths.base_name(path)).alias("capitalized"),
        F.startswith(path, F.lit("src")).alias("has_prefix"),
        F.endswith(path, F.lit(".go")).alias("has_suffix"),
        F.contains(path, F.lit("/f1")).alias("has_part"),
        F.coalesce(F.get(F.split(path, "/", 2), F.lit(1)), F.lit("")).alias("rest"),
        _big(F.size(text.fields(line))).alias("n_fields"),
        text.trim_space(F.concat(F.lit(" \t"), line, F.lit("\t "))).alias("trimmed"),
        text.trim_suffix(path, ".go").alias("no_suffix"),
        text.trim_prefix(path, "src").alias("no_prefix"),
        F.regexp_replace(path, "^([^/]*)/", "$1:").alias("first_replaced"),
        F.upper(paths.extension(path)).alias("upper_ext"),
        F.lower(paths.stem(path)).alias("lower_stem"),
        paths.dir_name(path).alias("dir"),
        F.concat_ws("/", paths.dir_name(path), paths.base_name(path)).alias("joined"),
    )


@query
def scalar_regex_lines(v: Views) -> DataFrame:
    """Line numbers of lines that begin with an upper-case word, for every text."""
    rows = v.code_files().select("doc_id", F.posexplode(text.lines(F.col("content"))).alias("pos", "line"))
    words = F.regexp_extract_all("line", F.lit(r"(\w+)\s+(\w+)"), F.lit(2))
    return (
        rows.where(F.rlike("line", F.lit(r"^[A-Z]\w*\s")))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_lines"),
            _big(F.min("pos") + 1).alias("first_line"),
            _big(F.max("pos") + 1).alias("last_line"),
            _big(F.sum(F.size(words))).alias("n_pairs"),
        )
    )


@query
def scalar_numbers_time(v: Views) -> DataFrame:
    price = F.col("o_totalprice")
    day = F.col("o_orderdate")
    return v.table("orders").select(
        "o_orderkey",
        text.number(price.cast("decimal(20,2)").cast("string")).alias("parsed"),
        F.coalesce(text.number(F.col("o_orderpriority")), F.lit(-1.0)).alias("unparsed"),
        cov.covered_estimate(_big("o_orderkey"), F.lit(1)).alias("truncated"),
        text.rfc3339(day).alias("rfc3339"),
        text.unix_seconds(day).alias("unix_seconds"),
        F.format_string("%s %d %.2f %+.2f", "o_orderstatus", "o_orderkey", price, price).alias("formatted"),
    )


@query
def scalar_collections(v: Views) -> DataFrame:
    frameworks = CONFIG.frameworks
    language = paths.language(F.col("path"))
    listed = F.array_append(F.split("path", "/", -1), F.lit("end"))
    record = F.to_json(F.struct("path", language.alias("language")))
    return v.code_files().select(
        "doc_id",
        text.lookup(language, frameworks, F.lit("none")).alias("framework"),
        _big(F.size(listed)).alias("n_parts"),
        F.get(listed, F.lit(0)).alias("first_part"),
        F.get_json_object(record, "$.path").alias("json_path"),
        F.from_json(record, "path STRING, language STRING")["language"].alias("json_language"),
    )


# Sources and sinks


@query
def source_files(v: Views) -> DataFrame:
    """Source table written in folders per repository and scanned again."""
    out = work_path(v.spark, "code-table")
    src_code.write_code_table(v.code_files().select("repo", "path", "content"), out)
    return src_code.read_code_table(v.spark, out).select("repo", "path", F.md5("content").alias("content_md5"))


@query
def small_files(v: Views) -> DataFrame:
    """Source files written one by one, listed, and read in partitions of equal bytes."""
    root, listing = work_path(v.spark, "tree"), work_path(v.spark, "listing")
    smallfiles.write_small_files(v.code_files(), root)
    smallfiles.write_listing(v.spark, root, listing)
    return smallfiles.read_small_files(v.spark, listing, target=1 << 20).select(
        "repo", "pr_id", "path", F.md5("content").alias("content_md5")
    )


@query
def test_dir_files(v: Views) -> DataFrame:
    """Test files below a root folder, with paths relative to it."""
    out = work_path(v.spark, "test-table")
    rooted = tp.unit_test_files(v.code_files(), CONFIG).select(
        "repo", F.concat(F.lit("generated/unit/"), F.col("test_path")).alias("path"), "content"
    )
    src_code.write_code_table(rooted, out)
    found = src_code.read_code_table(v.spark, out).withColumn(
        "path", paths.relative_to(F.col("path"), "generated/unit")
    )
    return found.where(paths.is_test_file(F.col("path"))).select("repo", "path", F.md5("content").alias("content_md5"))


@query
def report_sink(v: Views) -> DataFrame:
    """Coverage reports written as JSON and read back through the display schema."""
    out = work_path(v.spark, "reports")
    sinks.write_json_report(_report(v), out)
    body = F.struct("coverage_before", "coverage_after", "coverage_delta", "coverage_target", "target_met")
    shown = v.spark.read.schema(src_cov.SUMMARY_SCHEMA + ", repo STRING, pr_id BIGINT").json(out).select(
        "repo", "pr_id", src_cov.parse_summary(F.to_json(body)).alias("report")
    )
    return shown.select("repo", "pr_id", "report.*")


@query
def change_sink(v: Views) -> DataFrame:
    """File changes written as JSON, one document per file, and read back."""
    out = work_path(v.spark, "changes")
    schema = "repo STRING, pr_id BIGINT, path STRING, status STRING, language STRING, lines_changed BIGINT, diff STRING"
    found = _analysis(v).file_changes(v.patches())
    sinks.write_json_report(found.select("repo", "pr_id", "path", "status", "language", "lines_changed", "diff"), out)
    shown = v.spark.read.schema(schema).json(out)
    return shown.withColumn("diff_md5", F.md5(F.coalesce("diff", F.lit("")))).drop("diff")


@query
def summary_sink(v: Views) -> DataFrame:
    """Generation and integration counters written as JSON and read back."""
    out = work_path(v.spark, "summaries")
    sinks.write_json_report(REGISTRY["run_summary"](v), out)
    counters = ["files_processed", "unit_tests_generated", "total_test_cases", "files_integrated", "duplicates_skipped"]
    schema = "repo STRING, " + ", ".join(f"{name} BIGINT" for name in counters)
    return v.spark.read.schema(schema).json(out).select("repo", *counters)


@query
def test_file_sink(v: Views) -> DataFrame:
    out = work_path(v.spark, "test-files")
    files = tp.unit_test_files(v.code_files(), CONFIG).select("repo", F.col("test_path").alias("path"), "content")
    sinks.write_test_files(files, out)
    return src_code.read_code_table(v.spark, out).select("repo", "path", F.md5("content").alias("content_md5"))


@query
def functional_sink(v: Views) -> DataFrame:
    out = work_path(v.spark, "functional-files")
    cases = tp.functional_cases(_analysis(v).semantic_changes)
    files = tp.single_case_files(cases).select("repo", "pr_id", F.col("test_path").alias("path"), "content")
    sinks.publish_functional_files(files, out)
    return src_code.read_code_table(v.spark, out).select("repo", "path", F.md5("content").alias("content_md5"))


@query
def baseline_sink(v: Views) -> DataFrame:
    """Baselines appended in two writes, then the newest one per project."""
    out = work_path(v.spark, "baselines")
    found = v.coverage_runs().where(F.col("kind") == "baseline").select(
        F.col("repo_key").cast("string").alias("repo"), "ts", "run_id", F.col("pct").alias("coverage")
    )
    high = F.col("coverage") >= CONFIG.coverage_target
    sinks.append_baselines(found.where(high), out)
    sinks.append_baselines(found.where(~high), out)
    return sinks.newest_baselines(v.spark.read.parquet(out))


@query
def stored_suite(v: Views) -> DataFrame:
    """The suite as a versioned table: stored, integrated by a run, the run repeated."""
    suite = versions.VersionedTable(v.spark, work_path(v.spark, "suite"), ["repo", "path"], buckets=8)
    existing = v.existing_tests()
    suite.upsert(existing, "suite")
    changed = dd.integrate_files(v.generated_files(), existing).where(F.col("action").isin("copied", "merged"))
    for _ in range(2):
        suite.upsert(changed.select("repo", "path", "content"), "integration")
    return suite.read().select("repo", "path", F.md5("content").alias("content_md5"))


@query
def stored_baselines(v: Views) -> DataFrame:
    """The newest baseline per project after two updates that overlap in time."""
    found = v.coverage_runs().where(F.col("kind") == "baseline").select(
        F.col("repo_key").cast("string").alias("repo"), "ts", "run_id", F.col("pct").alias("coverage")
    )
    table = versions.VersionedTable(v.spark, work_path(v.spark, "baselines"), ["repo"], ["ts", "run_id"], buckets=8)
    for n in (1, 0):
        table.upsert(found.where(F.col("run_id") % 2 == n), f"part {n}")
    return table.read().select("repo", "coverage")


# Streaming


@query
def pr_events(v: Views) -> DataFrame:
    """Events as pull-request events, taken through the stream until used up."""
    raw = stream.read_events(v.spark, v.sf_dir, v.table("events").schema, "events.parquet")
    kinds = {"signup": "opened", "purchase": "synchronize", "error": "reopened"}
    events = raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        text.lookup(F.col("event_type"), kinds, F.lit("other")).alias("kind"),
    )
    out = work_path(v.spark, "pr-events")
    running = stream.start_runs(stream.run_requests(events), out, work_path(v.spark, "pr-events-state"))
    running.awaitTermination()
    return v.spark.read.parquet(out).select("event_id", "user_id", "kind")


def _run_requests(v: Views, analyse=None) -> str:
    """Events as events of the pull requests of the change list, taken through keyed state."""
    raw = stream.read_events(v.spark, v.sf_dir, v.table("events").schema, "events.parquet")
    kinds = {"signup": "opened", "purchase": "synchronize", "error": "reopened"}
    user = F.col("user_id")
    events = raw.select(
        F.concat(F.lit("repo"), (user % 10).cast("string")).alias("repo"), (user % 100).alias("pr_id"), "event_id",
        F.col("ts").cast("timestamp").alias("ts"), text.lookup(F.col("event_type"), kinds, F.lit("other")).alias("kind"),
    )
    out = work_path(v.spark, "run-requests")
    now = requests.Timing(pause=timedelta(0))
    requests.start(events, out, work_path(v.spark, "run-requests-state"), now, analyse).awaitTermination()
    return out


@query
def run_requests(v: Views) -> DataFrame:
    """What became of every event: the newest of each request starts a run."""
    rows = v.spark.read.parquet(f"{_run_requests(v)}/outcomes")
    return rows.select("repo", "pr_id", "event_id", "kind", "outcome")


@query
def started_analyses(v: Views) -> DataFrame:
    """The counters of the analyses that the stream has started."""
    out = _run_requests(v, runs.analysis_of(_changes(v).drop("doc_id"), v.code_files(), CONFIG))
    return v.spark.read.parquet(f"{out}/analysis").drop("batch")


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries in the form the driver calls."""

    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in REGISTRY.items()}
