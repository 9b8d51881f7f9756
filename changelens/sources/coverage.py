"""Coverage reports: JSON documents and log text of three tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text

REPORT_SCHEMA = (
    "coverage DOUBLE, totals STRUCT<percent_covered: DOUBLE>, "
    "total STRUCT<lines: STRUCT<pct: DOUBLE>>"
)
SUMMARY_SCHEMA = (
    "coverage_before DOUBLE, coverage_after DOUBLE, coverage_delta DOUBLE, "
    "coverage_target DOUBLE, target_met BOOLEAN"
)


def read_json_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row (log, folder columns) per log file of a layout such as repo=.../run_id=.../."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "log")


def parse_report(body: Column) -> Column:
    return F.from_json(body, REPORT_SCHEMA)


def report_percent(report: Column, tool: Column) -> Column:
    """Percentage of a parsed report; an absent number is 0, an unreadable report null."""
    value = (
        F.when(tool == "python", report["totals"]["percent_covered"])
        .when(tool == "javascript", report["total"]["lines"]["pct"])
        .otherwise(report["coverage"])
    )
    return F.when(report.isNotNull(), F.coalesce(value, F.lit(0.0)))


def parse_summary(body: Column) -> Column:
    """The stored coverage report, read back for display."""
    return F.from_json(body, SUMMARY_SCHEMA)


def _lines_with(log: Column, marker: str) -> Column:
    return F.filter(text.lines(log), lambda line: F.contains(line, F.lit(marker)))


def log_percent_go(log: Column) -> Column:
    """The first readable number after a `coverage:` field, 0 when there is none."""
    tokens = F.regexp_extract_all(log, F.lit(r"(?<!\S)coverage:[^\S\n]+(\S+)"), F.lit(1))
    return F.coalesce(text.first_parsed(F.transform(tokens, text.percent)), F.lit(0.0))


def log_percent_go_total(log: Column) -> Column:
    """The third field of the last readable `total:` line, 0 when there is none."""
    totals = F.filter(
        text.lines(log), lambda line: F.startswith(text.trim_space(line), F.lit("total:"))
    )
    values = F.transform(totals, lambda line: text.percent(text.field(line, 2)))
    return F.coalesce(text.last_parsed(values), F.lit(0.0))


def log_percent_script(log: Column) -> Column:
    """The tenth field of the `All files` row."""
    row = F.get(_lines_with(log, "All files"), F.lit(0))
    return F.coalesce(text.percent(text.field(row, 9)), F.lit(0.0))


def log_percent_python(log: Column) -> Column:
    """The fourth field of the `TOTAL` row."""
    row = F.get(_lines_with(log, "TOTAL"), F.lit(0))
    return F.coalesce(text.percent(text.field(row, 3)), F.lit(0.0))


def log_percent(log: Column, project_type: Column) -> Column:
    """Percentage by project type, null for a type without a reader."""
    go = F.coalesce(text.unless_zero(log_percent_go(log)), log_percent_go_total(log))
    return (
        F.when(project_type == "go", go)
        .when(project_type == "python", log_percent_python(log))
        .when(project_type.isin("javascript", "typescript"), log_percent_script(log))
    )
