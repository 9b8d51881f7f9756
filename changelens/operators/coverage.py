"""Coverage analytics: before, after, delta and target per pull request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import fixed, paths, text
from changelens.operators.changes import KEYS
from changelens.operators.ordered import carry_forward


def project_types(
    files: DataFrame, markers: tuple[tuple[str, str], ...] = fixed.PROJECT_MARKERS
) -> DataFrame:
    """Project type per repository from the marker files at its root."""
    ranks = {name: str(rank) for rank, (name, _) in enumerate(markers)}
    kinds = {str(rank): kind for rank, (_, kind) in enumerate(markers)}
    rank = text.lookup(F.col("path"), ranks, F.lit(None).cast("string")).cast("int")
    first = files.groupBy("repo").agg(F.min(rank).alias("_rank"))
    return first.select(
        "repo",
        text.lookup(
            F.coalesce(F.col("_rank").cast("string"), F.lit("")), kinds, F.lit(fixed.UNKNOWN_PROJECT)
        ).alias("project_type"),
    )


def with_baseline(runs: DataFrame, key: str = "repo") -> DataFrame:
    """Pull-request runs with the newest baseline of their project before them.

    `runs` holds both sorts of rows: kind 'baseline' and kind 'pr'. Without an
    earlier baseline `coverage_before` is null.
    """
    baseline = F.when(F.col("kind") == "baseline", F.col("pct"))
    found = carry_forward(runs, [key], ["ts", "run_id"], baseline, "coverage_before")
    return found.where(F.col("kind") == "pr")


def before_after(before: Column, after: Column) -> dict[str, Column]:
    """The pair with its defaults: without a baseline, the first run of a project, the
    current state is the baseline; no current value is the baseline; neither is 0."""
    known = F.coalesce(before, after, F.lit(0.0))
    current = F.coalesce(after, known)
    return {
        "coverage_before": known,
        "coverage_after": current,
        "coverage_delta": current - known,
    }


def join_before_after(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Before and after values (keys, pct) of the same pull requests, one row each."""
    pair = before.withColumnRenamed("pct", "before_pct").join(
        after.withColumnRenamed("pct", "after_pct"), list(keys), "full_outer"
    )
    return pair.select(*keys, *[c.alias(n) for n, c in before_after(F.col("before_pct"), F.col("after_pct")).items()])


def covered_estimate(total: Column, n_symbols: Column) -> Column:
    """Covered share of the changed lines, whole lines; 0 when no symbol changed."""
    share = F.floor(total.cast("double") * F.lit(fixed.COVERED_SHARE)).cast("bigint")
    return F.when(n_symbols > 0, share).otherwise(F.lit(0).cast("bigint"))


def coverage_report(
    runs: DataFrame,
    line_totals: DataFrame,
    symbol_counts: DataFrame,
    config: JobConfig = JobConfig(),
    keys: tuple[str, ...] = KEYS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """One report row per pull-request run.

    `runs` holds coverage_before and pct; `line_totals` new_lines_total and
    `symbol_counts` n_symbols, one row per pull request each. `measured` may hold
    n_covered, the new lines that ran by the coverage data; requests it lacks get the
    estimate. All these meet first, so that the runs, of which one request may have
    very many, take part in a single join that adaptive execution can split.
    """
    totals = line_totals.join(symbol_counts, list(keys), "full_outer")
    if measured is None:
        totals = totals.withColumn("n_covered", F.lit(None).cast("bigint"))
    else:
        totals = totals.join(measured.select(*keys, "n_covered"), list(keys), "full_outer")
    pair = before_after(F.col("coverage_before"), F.col("pct"))
    joined = (
        runs.withColumns({f"_{name}": value for name, value in pair.items()})
        .drop("coverage_before")
        .withColumnsRenamed({f"_{name}": name for name in pair})
        .join(totals, list(keys), "left")
        .fillna(0, ["new_lines_total", "n_symbols"])
    )
    covered = covered_estimate(F.col("new_lines_total"), F.col("n_symbols"))
    target = F.lit(config.coverage_target)
    return joined.select(
        *keys,
        "ts",
        *pair,
        F.coalesce("n_covered", covered).alias("new_lines_covered"),
        covered.alias("new_lines_covered_est"),
        "new_lines_total",
        target.alias("coverage_target"),
        (F.col("coverage_after") >= target).alias("target_met"),
    )


def summary_text(report: DataFrame) -> DataFrame:
    """Readable text of a report row."""
    met = F.when(F.col("target_met"), "met").otherwise("not met")
    shape = (
        "Before: %.2f%%\nAfter:  %.2f%%\nChange: %+.2f%%\n"
        "New lines covered: %d/%d\nTarget: %.2f%% (%s)"
    )
    return report.withColumn(
        "summary",
        F.format_string(
            shape,
            "coverage_before",
            "coverage_after",
            "coverage_delta",
            "new_lines_covered",
            "new_lines_total",
            "coverage_target",
            met,
        ),
    )


def with_linked_request(report: DataFrame, links: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Attach the number of the linked functional-test pull request."""
    joined = report.join(links.select(*keys, "linked_pr"), list(keys), "left")
    line = F.coalesce(
        F.concat(F.lit("Functional tests: #"), F.col("linked_pr").cast("string")),
        F.lit("No functional tests"),
    )
    return joined.withColumn("link_line", line)


def gates(report: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """Coverage gates and the shortfall to the target."""
    delta = F.col("coverage_delta")
    decrease_ok = (delta >= 0) | F.lit(not config.fail_on_decrease)
    return report.withColumns(
        {
            "decrease_ok": decrease_ok,
            "increase_ok": delta >= F.lit(config.min_coverage_increase),
            "shortfall": F.greatest(F.col("coverage_target") - F.col("coverage_after"), F.lit(0.0)),
        }
    )


def with_thresholds(
    report: DataFrame, thresholds: DataFrame, config: JobConfig = JobConfig()
) -> DataFrame:
    """Target per project (repo, threshold), the job's target where there is none."""
    joined = report.drop("coverage_target", "target_met").join(thresholds, "repo", "left")
    target = F.coalesce(F.col("threshold"), F.lit(config.coverage_target))
    return (
        joined.withColumn("coverage_target", target)
        .withColumn("target_met", F.col("coverage_after") >= F.col("coverage_target"))
        .drop("threshold")
    )


def comment_body(report: DataFrame) -> DataFrame:
    """Text of a pull-request comment from a report row with test counters."""
    shape = (
        "Unit tests: %d\nFunctional tests: %d\n"
        "Coverage: %.2f%% to %.2f%% (%+.2f%%)"
    )
    return report.withColumn(
        "body",
        F.format_string(
            shape,
            "unit_count",
            "functional_count",
            "coverage_before",
            "coverage_after",
            "coverage_delta",
        ),
    )


def run_summary(
    generation: DataFrame, integration: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Generation counters, integration counters and the pull request in one row.

    A key that only one of the two has counted gets zeros for the other.
    """
    on = list(keys)
    counters = [c for c in (*generation.columns, *integration.columns) if c not in on]
    return (
        generation.join(integration, on, "full_outer").fillna(0, counters).join(requests, on, "left")
    )


def _filled(rows: DataFrame, *names: str) -> DataFrame:
    """Subtotal rows carry '' in the place of the key they sum over."""
    return rows.fillna("", list(names))


def change_rollup(changes: DataFrame) -> DataFrame:
    """Files and lines per repository and module with subtotals."""
    rows = changes.select("repo", paths.module(F.col("path")).alias("module"), "lines_changed")
    totals = rows.rollup("repo", "module").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n_files"),
        F.sum("lines_changed").alias("lines_changed"),
    )
    return _filled(totals, "repo", "module")


def tests_per_request(plan: DataFrame) -> DataFrame:
    """Planned cases and test files per pull request, with subtotals per repository and overall."""
    per_file = plan.groupBy("repo", F.col("pr_id").cast("string").alias("pr_id"), "test_path").agg(
        F.count("*").alias("n")
    )
    totals = per_file.rollup("repo", "pr_id").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n_cases"),
        F.count("*").alias("n_test_files"),
    )
    return _filled(totals, "repo", "pr_id")


def generation_metrics(attempts: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Mean duration and share of successes per repository (duration, failed)."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("n_attempts"),
        F.avg("duration").alias("mean_duration"),
        (F.count_if(~F.col("failed")) / F.count("*")).alias("success_rate"),
    )


def coverage_trend(runs: DataFrame, key: str = "repo") -> DataFrame:
    """Improvement of every run over the run before it in the same project."""
    found = carry_forward(
        runs.select(key, "run_id", "ts", "pct"), [key], ["ts", "run_id"], F.col("pct"), "previous_pct"
    )
    return found.withColumn("improvement", F.col("pct") - F.col("previous_pct"))


def request_retries(attempts: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """Failed attempts per request and whether another try is allowed."""
    failures = F.count_if(F.col("failed"))
    succeeded = F.count_if(~F.col("failed")) > 0
    return attempts.groupBy("request_id").agg(
        F.count("*").alias("n_attempts"),
        failures.alias("n_failed"),
        ((failures > 0) & (failures <= config.max_retries) & ~succeeded).alias("may_retry"),
    )
