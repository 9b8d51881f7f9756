"""Whole runs composed of operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.operators import changes as ch
from changelens.operators import covered
from changelens.operators import symbols as sy
from changelens.operators import testplan as tp


def modified_sources(
    changes: DataFrame, files: DataFrame, config: JobConfig = JobConfig(), keys: tuple[str, ...] = ch.KEYS
) -> DataFrame:
    """Source text of the files that are to be analyzed, for prompts.

    The join shuffles the texts of all files of a supported language, unless the changes
    are few enough to be broadcast. Where symbols are enough, use `modified_symbols`.
    """
    wanted = ch.analyzable_files(ch.modified_files(changes, config.include_added))
    return files.select(*keys, "path", "content").join(
        wanted.select(*keys, "path"), [*keys, "path"], "left_semi"
    )


def modified_symbols(
    changes: DataFrame, files: DataFrame, config: JobConfig = JobConfig(), keys: tuple[str, ...] = ch.KEYS
) -> DataFrame:
    """Symbols of the files that are to be analyzed.

    They are extracted where the text is read and joined as short rows, so no text is
    shuffled; a file that did not change costs its extraction.
    """
    wanted = ch.analyzable_files(ch.modified_files(changes, config.include_added))
    found = sy.symbols(ch.analyzable_files(files).select(*ch.KEYS, "path", "content"))
    return found.join(wanted.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")


class ChangeAnalysis:
    """The tables of one analysis; all share (repo, pr_id) and are planned on first use."""

    def __init__(
        self,
        changes: DataFrame,
        files: DataFrame,
        config: JobConfig = JobConfig(),
    ):
        self._listed = changes
        self._changes = ch.routed(changes, config.include_renames)
        self._files = files
        self._config = config

    def file_changes(self, patches: DataFrame) -> DataFrame:
        """File changes with language, line counts and patch text."""
        return ch.file_changes(self._changes, patches)

    @cached_property
    def symbols(self) -> DataFrame:
        return modified_symbols(self._changes, self._files, self._config)

    def symbol_counts(self) -> DataFrame:
        """n_symbols per pull request over the files that are to be analyzed."""
        wanted = ch.analyzable_files(ch.modified_files(self._changes, self._config.include_added))
        numbers = sy.symbol_numbers(ch.analyzable_files(self._files).select(*ch.KEYS, "path", "content"))
        mine = numbers.join(wanted.select(*ch.KEYS, "path").distinct(), [*ch.KEYS, "path"], "left_semi")
        return mine.groupBy(*ch.KEYS).agg(F.sum("n_symbols").alias("n_symbols"))

    @cached_property
    def semantic_changes(self) -> DataFrame:
        return sy.semantic_changes(self.symbols)

    @cached_property
    def modules(self) -> DataFrame:
        return ch.affected_modules(ch.modified_files(self._changes))

    def test_plan(self) -> DataFrame:
        return tp.test_plan(self.symbols, self.modules, self._config)

    def generation_stats(self) -> DataFrame:
        """Counters of every run in the change list, also of those without a routed change."""
        return tp.generation_stats(self._listed, self.symbols, self._config)

    def covered_lines(self, patches: DataFrame, ranges: DataFrame) -> DataFrame:
        """Covered new lines per pull request: added lines of the patches against the line
        ranges of coverage profiles (repo, pr_id, path, start, end, hits), estimated for
        requests that no profile mentions."""
        wanted = self._changes.where(ch.has_status("M", "A")).select(*ch.KEYS, "path")
        added = covered.patch_ranges(patches.join(wanted, [*ch.KEYS, "path"], "left_semi"))
        per_file = covered.covered_lines(added, ranges, (*ch.KEYS, "path"))
        return covered.covered_totals(
            per_file, ch.new_lines(self.file_changes(patches)), self.symbol_counts()
        )


def analysis_of(
    changes: DataFrame, files: DataFrame, config: JobConfig = JobConfig()
) -> Callable[[DataFrame], DataFrame]:
    """What a stream of run requests (repo, pr_id, ...) starts: the counters of these requests."""

    def analyse(requests: DataFrame) -> DataFrame:
        wanted = requests.select(*ch.KEYS).distinct()
        mine = [table.join(wanted, list(ch.KEYS), "left_semi") for table in (changes, files)]
        return ChangeAnalysis(*mine, config).generation_stats()

    return analyse

