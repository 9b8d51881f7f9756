"""Line differences between two snapshots as hunks with line ranges: patience difference.

Lines are compared by a 64-bit hash within their file; only numbers and hashes of the
lines of modified files are shuffled. The lines that still have no partner lie in
segments: what is between two neighbouring pairs of matched lines, named by the pair
before it. One round matches equal lines at both ends of every segment, then takes the
lines that occur once on either side as anchors and keeps a longest run of them that
rises on both sides. The kept anchors split the segment; segments without anchors are
hunks. Rounds go on, for all files at once, while anchors are found.

A segment's lines are contiguous on both sides, so their place in it follows from the
line number, and ends are matched by sums over places, without sorting. Anchors of one
segment, two numbers each, meet in one task; a segment is part of one file at most.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import text
from changelens.operators.changes import diff_snapshots
from changelens.session import pinned

FILE = ["repo", "path"]
SEGMENT = [*FILE, "base_before", "head_before"]


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising run. Of several, the one found from its end:
    each time the last index that can stand there."""
    tops: list[int] = []
    where: list[int] = []
    previous: list[int] = []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        previous.append(where[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            where.append(i)
        else:
            tops[at], where[at] = value, i
    run, i = [], where[-1] if where else -1
    while i >= 0:
        run.append(i)
        i = previous[i]
    return run[::-1]


def _rising(anchors: pd.DataFrame) -> pd.DataFrame:
    ordered = anchors.sort_values("base_no", ignore_index=True)
    return ordered.iloc[longest_rising(ordered["head_no"].tolist())]


def _lines(files: DataFrame, changed: DataFrame, side: str) -> DataFrame:
    kept = files.join(changed, FILE, "left_semi")
    rows = kept.select(*FILE, F.posexplode(text.lines(F.col("content"))).alias("pos", "line"))
    zero = F.lit(0).cast("long")
    return rows.select(
        *FILE, zero.alias("base_before"), zero.alias("head_before"), F.lit(side == "base").alias("is_base"),
        (F.col("pos") + 1).cast("long").alias("no"), F.xxhash64("line").alias("line"),
    )


def _place(base: str = "base_before", head: str = "head_before") -> Column:
    """Place of a line in its segment, from 1."""
    return F.col("no") - F.when(F.col("is_base"), F.col(base)).otherwise(F.col(head))


def _equal_until(placed: DataFrame, place: str) -> DataFrame:
    """Per segment how many places from the first on hold equal lines of both sides."""
    both = placed.groupBy(*SEGMENT, place).agg(
        F.max(F.when(F.col("is_base"), F.col("line"))).alias("b"), F.max(F.when(~F.col("is_base"), F.col("line"))).alias("h")
    )
    differs = ~F.coalesce(F.col("b") == F.col("h"), F.lit(False))
    return both.groupBy(*SEGMENT).agg(
        F.coalesce(F.min(F.when(differs, F.col(place))) - 1, F.max(place)).alias(f"equal_{place}")
    )


def _trimmed(lines: DataFrame) -> DataFrame:
    """The lines without those that are equal at the ends of their segment; what remains of
    a segment begins behind the pairs of its first end."""
    sizes = lines.groupBy(*SEGMENT).agg(
        F.count_if("is_base").alias("n_base"), F.count_if(~F.col("is_base")).alias("n_head")
    )
    own = F.when(F.col("is_base"), F.col("n_base")).otherwise(F.col("n_head"))
    placed = lines.join(sizes, SEGMENT).withColumn("first", _place()).withColumn("last", own - F.col("first") + 1)
    ends = _equal_until(placed, "first").join(_equal_until(placed, "last"), SEGMENT)
    free = F.least("n_base", "n_head") - F.col("equal_first")
    kept = placed.join(ends, SEGMENT).where(
        (F.col("first") > F.col("equal_first")) & (F.col("last") > F.least(F.col("equal_last"), free))
    )
    return kept.select(
        *FILE, *[(F.col(c) + F.col("equal_first")).alias(c) for c in SEGMENT[2:]], "is_base", "no", "line"
    )


def _anchors(lines: DataFrame) -> DataFrame:
    """Pairs (base_no, head_no) per segment that keep their order."""
    base = F.col("is_base")
    counted = lines.groupBy(*SEGMENT, "line").agg(
        F.count_if(base).alias("n_base"), F.count_if(~base).alias("n_head"),
        F.min(F.when(base, F.col("no"))).alias("base_no"), F.min(F.when(~base, F.col("no"))).alias("head_no"),
    )
    unique = counted.where("n_base = 1 and n_head = 1").select(*SEGMENT, "base_no", "head_no")
    return unique.groupBy(*SEGMENT).applyInPandas(_rising, unique.schema)


def _split(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """The lines but the anchors, each in the segment behind the last anchor before it."""
    pair = F.struct(F.col("base_no").alias("base"), F.col("head_no").alias("head"))
    marks = [
        anchors.select(*SEGMENT, F.lit(side == "base").alias("is_base"), F.col(f"{side}_no").alias("no"), pair.alias("pair"))
        for side in ("base", "head")
    ]
    side = [*SEGMENT, "is_base"]
    marked = lines.join(marks[0].union(marks[1]), [*side, "no"], "left")
    last = F.last("pair", ignorenulls=True).over(Window.partitionBy(*side).orderBy("no"))
    found = marked.withColumn("last_pair", last).where("pair is null")
    return found.select(
        *FILE, F.coalesce("last_pair.base", "base_before").alias("base_before"),
        F.coalesce("last_pair.head", "head_before").alias("head_before"), "is_base", "no", "line",
    )


def _as_hunks(lines: DataFrame) -> DataFrame:
    counted = lines.groupBy(*SEGMENT).agg(
        F.count_if("is_base").alias("base_lines"), F.count_if(~F.col("is_base")).alias("head_lines")
    )
    return counted.select(
        *FILE,
        *[
            (F.col(f"{s}_before") + (F.col(f"{s}_lines") > 0).cast("long")).alias(f"{s}_start") if c == "start" else F.col(f"{s}_{c}")
            for s in ("base", "head")
            for c in ("start", "lines")
        ],
    )


def line_hunks(base: DataFrame, head: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Hunks between two snapshots (repo, path, content): repo, path, base_start, base_lines,
    head_start, head_lines.

    Line numbers count from 1; a side without lines has the number of the line before the
    hunk. An added or deleted file is one hunk. `changed` (repo, path, status) saves the
    comparison of the snapshots."""
    changed = pinned(diff_snapshots(base, head) if changed is None else changed)
    both = changed.where("status = 'M'")
    lines = _lines(base, both, "base").union(_lines(head, both, "head"))
    hunks = []
    while True:
        lines = pinned(_trimmed(lines))
        anchors = pinned(_anchors(lines))
        found = anchors.select(*SEGMENT).distinct()
        hunks.append(_as_hunks(lines.join(found, SEGMENT, "left_anti")))
        if anchors.isEmpty():
            break
        lines = pinned(_split(lines.join(found, SEGMENT, "left_semi"), anchors))
    n_lines = F.size(text.lines(F.col("content"))).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    for files, status, order in ((base, "D", (one, n_lines, zero, zero)), (head, "A", (zero, zero, one, n_lines))):
        names = ("base_start", "base_lines", "head_start", "head_lines")
        whole = files.join(changed.where(F.col("status") == status), FILE, "left_semi")
        hunks.append(whole.select(*FILE, *[c.alias(n) for c, n in zip(order, names, strict=True)]))
    result = hunks[0]
    for part in hunks[1:]:
        result = result.union(part)
    return result


def hunk_lines(hunks: DataFrame) -> DataFrame:
    """Lines added and removed per path, moved lines included."""
    return hunks.groupBy(*FILE).agg(F.sum("head_lines").alias("lines_added"), F.sum("base_lines").alias("lines_removed"))
