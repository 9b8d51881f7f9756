"""Which lines tests ran: coverage profiles of three tools as line ranges.

Each parser explodes a column of report texts in the scan: one row per range, with
path, start, end (line numbers from 1, both included) and hits. Lines that can't be
read are skipped; null and empty texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import text

RANGE = ("path", "start", "end", "hits")
# The formats' own markers and names.
_BLOCK = r"^(.+):(\d{1,9})\.\d+,(\d{1,9})\.\d+ \d+ (\d{1,18})$"
_FILE, _LINE, _END = "SF:", "DA:", "end_of_record"
_LINE_LISTS = "files MAP<STRING, STRUCT<executed_lines: ARRAY<INT>, missing_lines: ARRAY<INT>>>"


def _number(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(line, pattern, group).cast("long")


def block_ranges(reports: DataFrame, keys: tuple[str, ...], body: str = "body") -> DataFrame:
    """Ranges of Go cover profiles: `path:line.column,line.column statements hits`."""
    rows = reports.select(*keys, F.explode(text.lines(F.col(body))).alias("line")).where(F.rlike("line", F.lit(_BLOCK)))
    line = F.col("line")
    return rows.select(
        *keys, F.regexp_extract(line, _BLOCK, 1).alias("path"),
        *[_number(line, _BLOCK, i).alias(c) for i, c in ((2, "start"), (3, "end"), (4, "hits"))],
    ).where("start <= end")


def record_ranges(reports: DataFrame, keys: tuple[str, ...], body: str = "body") -> DataFrame:
    """Ranges of trace files: per record `SF:path`, `DA:line,hits` and `end_of_record`."""
    records = F.split(F.col(body), _END)
    rows = reports.select(*keys, F.explode(records).alias("record")).select(
        *keys, F.regexp_extract("record", rf"(?m)^{_FILE}(.*)$", 1).alias("path"), F.explode(text.lines(F.col("record"))).alias("line")
    )
    pattern = rf"^{_LINE}(\d{{1,9}}),(\d{{1,18}})(?:,.*)?$"
    no = _number(F.col("line"), pattern, 1)
    rows = rows.where((F.col("path") != "") & F.rlike("line", F.lit(pattern)))
    return rows.select(*keys, "path", no.alias("start"), no.alias("end"), _number(F.col("line"), pattern, 2).alias("hits"))


def list_ranges(reports: DataFrame, keys: tuple[str, ...], body: str = "body") -> DataFrame:
    """Ranges of JSON reports with the executed and the missing lines of each file."""
    files = F.from_json(F.col(body), _LINE_LISTS)["files"]
    rows = reports.select(*keys, F.explode(files).alias("path", "lists"))

    def marked(field: str, hits: int) -> Column:
        return F.transform(
            F.coalesce(F.col("lists")[field], F.array().cast("array<int>")),
            lambda no: F.struct(no.cast("long").alias("no"), F.lit(hits).cast("long").alias("hits")),
        )

    both = F.concat(marked("executed_lines", 1), marked("missing_lines", 0))
    found = rows.select(*keys, "path", F.explode(both).alias("l")).where("l.no > 0")
    return found.select(*keys, "path", F.col("l.no").alias("start"), F.col("l.no").alias("end"), "l.hits")


PARSERS = {"go": block_ranges, "python": list_ranges, "javascript": record_ranges}


def profile_ranges(reports: DataFrame, keys: tuple[str, ...], tool: str = "tool", body: str = "body") -> DataFrame:
    """Ranges of reports of all tools; `tool` names the project type of each report."""
    parts = [parse(reports.where(F.col(tool) == name), keys, body) for name, parse in PARSERS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
