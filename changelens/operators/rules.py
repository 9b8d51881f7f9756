"""Configured generation rules: minimum size, path globs, cap of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions.text import glob_regex


def large_enough(changes: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    return changes.where(F.col("lines_changed") >= config.min_lines_changed)


def included(files: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """Files that match an include glob and no exclude glob."""
    wanted = F.rlike("path", F.lit(glob_regex(config.include_globs)))
    unwanted = F.rlike("path", F.lit(glob_regex(config.exclude_globs)))
    return files.where(wanted & ~unwanted)
