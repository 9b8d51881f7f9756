"""Change analytics: which files changed, how, in which language and module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import paths, text

KEYS = ("repo", "pr_id")


def status_class(status: Column) -> Column:
    return F.substring(status, 1, 1)


def has_status(*letters: str) -> Column:
    """Condition on the first letter of the status, in a form that file scans can evaluate."""
    tests = [F.startswith(F.col("status"), F.lit(letter)) for letter in letters]
    return reduce(Column.__or__, tests)


def routed(changes: DataFrame, include_renames: bool = False) -> DataFrame:
    """Modified, added and deleted files; other status letters are dropped by default."""
    wanted = ["M", "A", "D"] + (["R", "C"] if include_renames else [])
    return changes.where(has_status(*wanted)).withColumn(
        "status_class", status_class(F.col("status"))
    )


def modified_files(changes: DataFrame, include_added: bool = False) -> DataFrame:
    """The files whose symbols are analyzed: modified ones, and added ones on request."""
    return changes.where(has_status(*(["M", "A"] if include_added else ["M"])))


def analyzable_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_analyzable(F.col("path")))


def _is_added(line: Column) -> Column:
    return F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))


def _is_removed(line: Column) -> Column:
    return F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---"))


def changed_lines(diff: Column) -> Column:
    """Number of added and removed lines of a patch."""
    kept = F.filter(text.lines(diff), lambda line: _is_added(line) | _is_removed(line))
    return F.size(kept)


def added_lines(diff: Column) -> Column:
    return F.size(F.filter(text.lines(diff), _is_added))


def with_patches(
    changes: DataFrame, patches: DataFrame, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Attach patch text and line counts; a file without a patch has '' and 0.

    The counts are taken before the join, on the side that holds the text.
    """
    counted = patches.select(
        *keys,
        "path",
        "diff",
        changed_lines(F.col("diff")).alias("lines_changed"),
        added_lines(F.col("diff")).alias("lines_added"),
    )
    return changes.join(counted, [*keys, "path"], "left").fillna(
        {"diff": "", "lines_changed": 0, "lines_added": 0}
    )


def file_changes(
    changes: DataFrame, patches: DataFrame, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """The complete file-change record: path, status, language, counts and patch."""
    kept = routed(changes).withColumn("language", paths.language(F.col("path")))
    return with_patches(kept, patches, keys)


def status_counts(changes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    cls = status_class(F.col("status"))
    return changes.groupBy(*keys).agg(
        F.count_if(cls == "M").alias("files_modified"),
        F.count_if(cls == "A").alias("files_added"),
        F.count_if(cls == "D").alias("files_deleted"),
    )


def new_lines(changes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Changed lines summed over modified and added files."""
    return (
        changes.where(has_status("M", "A"))
        .groupBy(*keys)
        .agg(F.sum("lines_changed").alias("new_lines_total"))
    )


def affected_modules(changes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Distinct modules, one row each."""
    return (
        changes.select(*keys, paths.module(F.col("path")).alias("module"))
        .where(F.col("module").isNotNull())
        .distinct()
    )


def file_counts(files: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Number of rows with a path."""
    return files.where(F.col("path") != "").groupBy(*keys).agg(F.count("*").alias("n_files"))


def preview(
    changes: DataFrame, order: list[str], limit: int = 10, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """The first files of each pull request and how many more there are.

    The rank filter lets Spark keep only `limit` rows per key before the
    shuffle; the total is counted apart, so no task sees a whole key, and only
    requests with more files than that take part in the join. The narrowest key
    leads, which makes the sort compare numbers most of the time.
    """
    by_order = Window.partitionBy(*reversed(keys)).orderBy(*order)
    first = changes.withColumn("rank", F.row_number().over(by_order)).where(F.col("rank") <= limit)
    longer = (
        changes.groupBy(*keys)
        .agg((F.count("*") - limit).alias("n_more"))
        .where(F.col("n_more") > 0)
    )
    return first.join(longer, list(keys), "left").fillna(0, ["n_more"])


def diff_snapshots(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, deleted and modified paths between two snapshots (repo, path, content).

    Only a digest of each text is shuffled.
    """

    def digests(files: DataFrame, name: str) -> DataFrame:
        return files.select("repo", "path", F.sha2("content", 256).alias(name))

    both = digests(base, "base_digest").join(digests(head, "head_digest"), ["repo", "path"], "full_outer")
    status = (
        F.when(F.col("base_digest").isNull(), "A")
        .when(F.col("head_digest").isNull(), "D")
        .when(F.col("base_digest") != F.col("head_digest"), "M")
    )
    return (
        both.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select("repo", "path", "status")
    )


def line_changes(base: DataFrame, head: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Lines added and removed per changed path, as a bag difference.

    Only the texts of changed paths leave the scan: both sides are reduced by a
    semi join first, and equal lines are counted before the shuffle. Moved
    lines are not seen.
    """
    changed = diff_snapshots(base, head) if changed is None else changed
    keys = changed.select("repo", "path")

    def signed(files: DataFrame, sign: int) -> DataFrame:
        return files.join(keys, ["repo", "path"], "left_semi").select(
            "repo", "path", F.explode(text.lines(F.col("content"))).alias("line"),
            F.lit(sign).alias("sign"),
        )

    balance = (
        signed(head, 1)
        .unionByName(signed(base, -1))
        .groupBy("repo", "path", "line")
        .agg(F.sum("sign").alias("balance"))
    )
    return balance.groupBy("repo", "path").agg(
        F.sum(F.greatest("balance", F.lit(0))).alias("lines_added"),
        F.sum(F.greatest(-F.col("balance"), F.lit(0))).alias("lines_removed"),
    )


def snapshot_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """File changes between two snapshots with line counts."""
    changed = diff_snapshots(base, head)
    return (
        changed.join(line_changes(base, head, changed), ["repo", "path"], "left")
        .fillna(0, ["lines_added", "lines_removed"])
        .withColumn("lines_changed", F.col("lines_added") + F.col("lines_removed"))
    )


def change_report(base: DataFrame, head: DataFrame) -> DataFrame:
    """What changed per repository, module and language."""
    cls = F.col("status")
    return (
        snapshot_changes(base, head)
        .groupBy(
            "repo",
            F.coalesce(paths.module(F.col("path")), F.lit("")).alias("module"),
            paths.language(F.col("path")).alias("language"),
        )
        .agg(
            F.count_if(cls == "M").alias("files_modified"),
            F.count_if(cls == "A").alias("files_added"),
            F.count_if(cls == "D").alias("files_deleted"),
            F.sum("lines_added").alias("lines_added"),
            F.sum("lines_removed").alias("lines_removed"),
            F.sum("lines_changed").alias("lines_changed"),
        )
    )
