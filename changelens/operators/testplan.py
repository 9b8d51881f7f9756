"""Test planning: the test cases that symbols, changes and modules call for.

Cases are derived row by row from symbols. Test files are assembled from the
row of their source file, so no group of rows is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import fixed, paths, templates, text
from changelens.operators.changes import KEYS, affected_modules, modified_files
from changelens.operators.symbols import high_impact, with_framework, with_symbols


def _case(name: Column, description: Column, case_type: str, code: Column) -> Column:
    return F.struct(
        name.alias("name"),
        description.alias("description"),
        F.lit(case_type).alias("case_type"),
        code.alias("code"),
    )


def _function_cases(name: Column, language: Column, edge_cases: bool) -> Column:
    test = F.concat(F.lit("Test"), text.capitalize(name))
    kinds = [k for k in fixed.FUNCTION_KINDS if edge_cases or k[0] != fixed.EDGE_KIND]
    return F.array(
        *[
            _case(
                F.concat(test, F.lit(suffix)),
                F.concat(F.lit("Test "), name, F.lit(" " + ending)),
                kind,
                templates.function_code(kind, language, name),
            )
            for kind, suffix, ending in kinds
        ]
    )


def _method_cases(owner: Column, methods: Column, language: Column) -> Column:
    return F.transform(
        methods,
        lambda method: _case(
            F.concat(F.lit("Test"), owner, F.lit("_"), text.capitalize(method)),
            F.concat(F.lit("Test "), owner, F.lit("."), method),
            "method_test",
            templates.method_code(language, owner, method),
        ),
    )


def symbol_cases(symbol: Column, language: Column, edge_cases: bool = True) -> Column:
    """Array of the test cases of one symbol; a class without methods has none."""
    return F.when(
        symbol["kind"] == "function", _function_cases(symbol["name"], language, edge_cases)
    ).otherwise(_method_cases(symbol["name"], symbol["methods"], language))


def case_count(kind: Column, methods: Column, edge_cases: bool = True) -> Column:
    per_function = len(fixed.FUNCTION_KINDS) - (0 if edge_cases else 1)
    return F.when(kind == "function", F.lit(per_function)).otherwise(F.size(methods))


def unit_cases(symbol_rows: DataFrame, config: JobConfig = JobConfig(), cap: bool = False) -> DataFrame:
    """Test cases of functions and methods.

    `cap` applies the configured maximum of cases per symbol.
    """
    keep = [
        c
        for c in ("repo", "pr_id", "path", "language", "kind")
        if c in symbol_rows.columns
    ]
    symbol = F.struct(F.col("kind"), F.col("name"), F.col("methods"))
    cases = symbol_cases(symbol, F.col("language"), config.generate_edge_cases)
    if cap:
        cases = F.slice(cases, 1, config.max_tests_per_function)
    source = F.col("name").alias("symbol")
    return symbol_rows.select(
        *keep, source, "ord", F.posexplode(cases).alias("case_ord", "case")
    ).select(*keep, "symbol", "ord", "case_ord", "case.*")


def _end_to_end_case(name: Column) -> Column:
    return _case(
        F.concat(F.lit("Test"), text.capitalize(name), F.lit("_E2E")),
        F.concat(F.lit("End-to-end test for "), name),
        "e2e",
        templates.end_to_end_code(name),
    )


def functional_cases(changes: DataFrame) -> DataFrame:
    """One end-to-end case per semantic change of high impact."""
    name = F.col("name")
    keep = [c for c in ("repo", "pr_id") if c in changes.columns]
    language = paths.test_language(F.col("file"))
    return high_impact(changes).select(
        *keep,
        F.col("file").alias("path"),
        language.alias("language"),
        name.alias("symbol"),
        _end_to_end_case(name).alias("case"),
        paths.functional_test_name(name, language).alias("test_path"),
    ).select(*keep, "path", "language", "symbol", "case.*", "test_path")


def integration_cases(modules: DataFrame) -> DataFrame:
    """One integration case per affected module."""
    module = F.col("module")
    keep = [c for c in ("repo", "pr_id") if c in modules.columns]
    return modules.select(
        *keep,
        F.lit(fixed.DEFAULT_TEST_LANGUAGE).alias("language"),
        module.alias("symbol"),
        F.concat(F.lit("Test"), text.capitalize(module), F.lit("_Integration")).alias("name"),
        F.concat(F.lit("Integration test for "), module, F.lit(" module")).alias("description"),
        F.lit("integration").alias("case_type"),
        templates.integration_code(module).alias("code"),
        paths.integration_test_name(module).alias("test_path"),
    )


def test_plan(
    symbol_rows: DataFrame, modules: DataFrame, config: JobConfig = JobConfig()
) -> DataFrame:
    """All planned cases: functions and methods, end-to-end, integration.

    The cases of a symbol, of whatever kind, come from one pass over the symbols.
    """
    keep = [c for c in ("repo", "pr_id", "path", "language") if c in symbol_rows.columns]
    name, language, path = F.col("name"), F.col("language"), F.col("path")
    symbol = F.struct(F.col("kind"), name, F.col("methods"))
    unit_path = paths.flat_test_name(path, language)
    unit = F.transform(
        symbol_cases(symbol, language, config.generate_edge_cases),
        lambda case: case.withField("test_path", unit_path),
    )
    functional_path = paths.functional_test_name(name, paths.test_language(path))
    functional = F.array(_end_to_end_case(name).withField("test_path", functional_path))
    is_high = (language == "go") & (F.col("kind") == "class")
    cases = F.when(is_high, F.concat(unit, functional)).otherwise(unit)
    planned = symbol_rows.select(*keep, name.alias("symbol"), F.explode(cases).alias("case")).select(
        *keep, "symbol", "case.*"
    )
    return planned.unionByName(integration_cases(modules), allowMissingColumns=True)


def enhanced_cases(cases: DataFrame, responses: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One more case per symbol that has a stored answer (keys, path, symbol, answer)."""
    symbol = F.col("symbol")
    first = cases.where(F.col("case_ord") == 0).select(*keys, "path", "language", "symbol", "ord")
    answered = first.join(responses.where(F.col("answer") != ""), [*keys, "path", "symbol"])
    return answered.select(
        *keys,
        "path",
        "language",
        "symbol",
        "ord",
        F.concat(F.lit("Test"), text.capitalize(symbol), F.lit("_Enhanced")).alias("name"),
        F.concat(F.lit("Enhanced test for "), symbol).alias("description"),
        F.lit("enhanced").alias("case_type"),
        F.col("answer").alias("code"),
    )


def generation_stats(
    changes: DataFrame,
    symbol_rows: DataFrame,
    config: JobConfig = JobConfig(),
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Generation counters: every function, class, high-impact change and module counts one.

    The inputs are stacked as rows of counters and summed once, so there is one
    shuffle of pre-aggregated rows and no join. Every change gives a row of zeros,
    so a run without a modified file has its row, too.
    """
    modified = modified_files(changes)
    one = F.lit(1)
    is_function = F.col("kind") == "function"
    is_high = ~is_function & (F.col("language") == "go")
    cases = case_count(F.col("kind"), F.col("methods"), config.generate_edge_cases)
    counters = (
        "files_processed", "unit_tests_generated", "functional_tests_generated", "total_test_cases",
    )

    def counted(rows: DataFrame, **values: Column) -> DataFrame:
        columns = [values.get(c, F.lit(0)).cast("bigint").alias(c) for c in counters]
        return rows.select(*keys, *columns)

    stacked = (
        counted(changes)
        .unionByName(counted(modified, files_processed=one))
        .unionByName(
            counted(
                symbol_rows,
                unit_tests_generated=one,
                functional_tests_generated=is_high.cast("int"),
                total_test_cases=cases + is_high.cast("int"),
            )
        )
        .unionByName(
            counted(affected_modules(modified, keys), unit_tests_generated=one, total_test_cases=one)
        )
    )
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def _file_text(language: Column, framework: Column, cases: Column) -> Column:
    blocks = F.transform(
        cases,
        lambda c: F.concat(
            templates.comment_mark(language), F.lit(" "), c["description"], F.lit("\n"),
            c["code"], F.lit("\n\n"),
        ),
    )
    return F.concat(templates.file_header(language, framework), F.lit("\n\n"), F.array_join(blocks, ""))


def unit_test_files(files: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """One test file per source file, with the cases of all its symbols in order."""
    keep = [c for c in ("repo", "pr_id", "path") if c in files.columns]
    language = F.col("language")
    cases = F.flatten(
        F.transform("symbols", lambda s: symbol_cases(s, language, config.generate_edge_cases))
    )
    found = with_framework(with_symbols(files), config.frameworks)
    return (
        found.select(*keep, "language", "framework", cases.alias("cases"))
        .select(
            *keep,
            paths.test_path_beside(F.col("path")).alias("test_path"),
            F.size("cases").alias("n_cases"),
            _file_text(language, F.col("framework"), F.col("cases")).alias("content"),
        )
    )


def unit_test_files_last_writer(
    files: DataFrame,
    config: JobConfig = JobConfig(),
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """The flat layout: files of one name overwrite each other, the last symbol stays.

    The order is: functions before classes, then source path, then text order.
    Each source file sends its own last symbol only, and `max_by` merges these
    before the shuffle.
    """
    found = with_framework(with_symbols(files), config.frameworks)
    last = F.element_at("symbols", -1)
    own = found.select(
        *keys,
        "path",
        "language",
        "framework",
        paths.flat_test_name(F.col("path"), F.col("language")).alias("test_path"),
        last.alias("symbol"),
    )
    rank = F.struct((F.col("symbol.kind") == "class").alias("late"), F.col("path"))
    winner = F.struct("path", "language", "framework", "symbol")
    kept = own.groupBy(*keys, "test_path").agg(F.max_by(winner, rank).alias("w")).select(
        *keys, "test_path", "w.*"
    )
    cases = symbol_cases(F.col("symbol"), F.col("language"), config.generate_edge_cases)
    return kept.withColumn("cases", cases).select(
        *keys,
        "test_path",
        F.col("symbol.name").alias("symbol"),
        F.size("cases").alias("n_cases"),
        _file_text(F.col("language"), F.col("framework"), F.col("cases")).alias("content"),
    )


def single_case_files(cases: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Test files of end-to-end and integration cases.

    The text depends on the name alone, so equal paths are reduced to one row.
    """
    distinct = cases.select(*keys, "test_path", "case_type", "description", "code").distinct()
    header = F.when(F.col("case_type") == "e2e", templates.FUNCTIONAL_HEADER).otherwise(
        templates.file_header(F.lit(fixed.DEFAULT_TEST_LANGUAGE), F.lit(fixed.DEFAULT_FRAMEWORK))
    )
    return distinct.select(
        *keys,
        "test_path",
        F.concat(
            header, F.lit("\n\n// "), F.col("description"), F.lit("\n"), F.col("code"),
            F.lit("\n\n"),
        ).alias("content"),
    )


def function_prompts(symbol_rows: DataFrame) -> DataFrame:
    """Prompt text per function, for symbols that carry their source text."""
    return symbol_rows.where((F.col("kind") == "function") & (F.col("content") != "")).withColumn(
        "prompt",
        text.fill(
            templates.FUNCTION_PROMPT,
            name=F.col("name"),
            language=F.col("language"),
            source=F.col("content"),
        ),
    )


def file_prompts(files: DataFrame, kind: str = "unit") -> DataFrame:
    """Prompt text per source file."""
    path = F.col("path")
    return files.withColumn(
        "prompt",
        text.fill(
            templates.FILE_PROMPT,
            kind=F.lit(kind),
            path=path,
            language=paths.display_language(path),
            extension=F.substring_index(path, ".", -1),
            source=F.col("content"),
        ),
    )


def path_rules(files: DataFrame) -> DataFrame:
    """Files the path-rule profile generates tests for, and whether functional ones too."""
    path = F.col("path")
    return files.where(~paths.is_skipped(path)).withColumn(
        "wants_functional", paths.is_functional_candidate(path)
    )


def names_by_pattern(symbol_rows: DataFrame, config: JobConfig = JobConfig()) -> DataFrame:
    """Test names from the configured patterns."""
    return symbol_rows.withColumns(
        {
            "unit_name": text.fill(config.unit_pattern, function_name=F.col("name")),
            "functional_name": text.fill(config.functional_pattern, feature_name=F.col("name")),
        }
    )
