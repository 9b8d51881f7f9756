"""Covered new lines from coverage data: an overlap join of line ranges.

Ranges are cut at multiples of 64 lines, and each piece becomes the 64 bits of its bin.
Pieces of one bin are combined (or) before the shuffle, so a file with very many or
overlapping ranges has one row per bin on either side; the join on (file, bin) compares
them bit by bit. Nothing is paired range by range, and no line counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import text
from changelens.operators.changes import KEYS
from changelens.operators.coverage import covered_estimate

BIN = 64
_HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+"


def _bits(start: Column, end: Column) -> Column:
    """Bits start to end (0 to 63) of a long."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (BIN - 1 - (end - start)).cast("int"))
    return F.call_function("shiftleft", ones, start.cast("int"))


def line_bins(ranges: DataFrame, keys: list[str], **marks: Column) -> DataFrame:
    """Per key and bin of 64 lines the lines in ranges (start, end; lines from 1) as bits, once
    for each mark, whose condition says which ranges count."""
    cut = F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))
    valid = ranges.where("start >= 1 and start <= end")
    pieces = valid.select(*keys, "start", "end", *[m.alias(f"_{n}") for n, m in marks.items()], F.explode(cut).alias("bin"))
    bits = _bits(
        F.greatest(F.col("start") - F.col("bin") * BIN, F.lit(0)), F.least(F.col("end") - F.col("bin") * BIN, F.lit(BIN - 1))
    )
    zero = F.lit(0).cast("long")
    return pieces.groupBy(*keys, "bin").agg(
        *[F.bit_or(F.when(F.col(f"_{n}"), bits).otherwise(zero)).alias(n) for n in marks]
    )


def covered_lines(changed: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Per file with changed lines: n_new (changed lines), n_known (of these, lines that the
    coverage data mention), n_covered (of these, lines that ran), has_data (whether the data
    mention the file at all).

    `changed`: keys, start, end of changed lines; `ranges`: keys, start, end, hits."""
    on = list(keys)
    new = line_bins(changed, on, new=F.lit(True))
    seen = line_bins(ranges, on, known=F.lit(True), ran=F.col("hits") > 0)
    files = seen.select(*on).distinct().withColumn("has_data", F.lit(True))
    both = new.join(seen, [*on, "bin"], "left")
    counted = both.groupBy(*on).agg(
        F.sum(F.bit_count("new")).alias("n_new"),
        F.sum(F.bit_count(F.col("new").bitwiseAND(F.coalesce("known", F.lit(0))))).alias("n_known"),
        F.sum(F.bit_count(F.col("new").bitwiseAND(F.coalesce("ran", F.lit(0))))).alias("n_covered"),
    )
    return counted.join(files, on, "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def hunk_ranges(hunks: DataFrame) -> DataFrame:
    """Changed line ranges of the new side from hunks between snapshots."""
    end = F.col("head_start") + F.col("head_lines") - 1
    return hunks.where("head_lines > 0").select("repo", "path", F.col("head_start").alias("start"), end.alias("end"))


def patch_ranges(patches: DataFrame, keys: tuple[str, ...] = (*KEYS, "path")) -> DataFrame:
    """Added line ranges of the new side from unified patches (keys, diff).

    Lines before the first hunk header are skipped; of a hunk, removed lines and remarks
    (`\\`) have no number on the new side."""
    sections = F.slice(F.split(F.col("diff"), _HUNK, -1), 2, 1 << 30)

    def added(section: Column) -> Column:
        first = F.regexp_extract(section, r"^(\d{1,9})", 1).cast("long")
        body = F.slice(text.lines(section), 2, 1 << 30)
        kept = F.filter(body, lambda line: ~F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("\\")))
        numbers = F.transform(kept, lambda line, i: F.when(F.startswith(line, F.lit("+")), first + i))
        return F.filter(numbers, lambda no: no.isNotNull())

    numbers = patches.select(*keys, F.explode(sections).alias("section")).where(F.rlike("section", F.lit(r"^\d")))
    numbers = numbers.select(*keys, added(F.col("section")).alias("nos")).where(F.size("nos") > 0)

    def runs(nos: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(nos, i)

        every = F.sequence(F.lit(0), F.size(nos) - 1)
        begins = F.filter(every, lambda i: (i == 0) | (at(i) != at(i - 1) + 1))
        ends = F.filter(every, lambda i: (i == F.size(nos) - 1) | (at(i) != at(i + 1) - 1))
        return F.zip_with(begins, ends, lambda b, e: F.struct(at(b).alias("start"), at(e).alias("end")))

    return numbers.select(*keys, F.explode(runs(F.col("nos"))).alias("r")).select(*keys, "r.*")


def covered_totals(
    per_file: DataFrame, line_totals: DataFrame, symbol_counts: DataFrame, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Covered and all new lines per pull request: what the coverage data say where any file
    of the request has data (`from_data`), the estimate elsewhere.

    `per_file`: keys and the counts of `covered_lines`; `line_totals`: keys and
    new_lines_total; `symbol_counts`: keys and n_symbols."""
    on = list(keys)
    measured = per_file.where("has_data").groupBy(*on).agg(
        F.sum("n_covered").alias("n_covered"), F.sum("n_known").alias("n_known")
    )
    joined = line_totals.join(symbol_counts, on, "left").fillna(0, ["n_symbols"]).join(measured, on, "left")
    estimate = covered_estimate(F.col("new_lines_total"), F.col("n_symbols"))
    known = F.col("n_known").isNotNull()
    return joined.select(
        *on,
        F.coalesce("n_covered", estimate).alias("new_lines_covered"),
        estimate.alias("new_lines_covered_est"),
        F.coalesce("n_known", "new_lines_total").alias("new_lines_measured"),
        "new_lines_total",
        known.alias("from_data"),
    )
