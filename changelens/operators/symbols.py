"""Symbol analytics: functions and classes that source files declare.

Each file is one row, and everything known about its symbols comes from that
row alone: extraction runs next to the scan, and methods are matched to their
structs inside the row. No shuffle is needed up to the flat symbol table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed, paths, text
from changelens.operators import declarations

# The same matches in less than half the time: most positions fail on one character.
_SCRIPT_FUNCTION = "(?=[fclv])" + fixed.SCRIPT_FUNCTION
_WITH_SYMBOLS = ("go", "python", "javascript", "typescript")


def _symbol(kind: str, type_: str | Column, name: Column, **more: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(type_) if isinstance(type_, str) else type_).alias("type"),
        name.alias("name"),
        more.get("line", F.lit(0)).cast("int").alias("line"),
        F.lit(False).alias("is_async"),
        more.get("args", none).alias("args"),
        more.get("methods", none).alias("methods"),
        more.get("receiver", F.lit("")).alias("receiver"),
    )


def _go_symbols(declared: Column) -> Column:
    def as_symbol(d: Column) -> Column:
        function = _symbol(
            "function", "function", d["name"], line=d["line"],
            args=declarations.arguments(d["parameters"]), receiver=d["receiver"],
        )
        return F.when(d["kind"] == "function", function).otherwise(_symbol("class", "struct", d["name"], line=d["line"]))

    return F.transform(declared, as_symbol)


def _attach_methods(symbols: Column) -> Column:
    """Give every struct the names of the methods that have it as receiver."""
    is_struct = F.exists(symbols, lambda s: s["type"] == "struct")
    attached = declarations.with_methods(
        symbols, lambda s: F.when(s["type"] == "struct", s["name"]).otherwise(""), lambda s: s["receiver"]
    )
    return F.when(is_struct, attached).otherwise(symbols)


def _named(names: Column, kind: str, type_: str) -> Column:
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: _symbol(kind, type_, n))


def _python_symbols(content: Column) -> Column:
    def find(pattern: str) -> Column:
        return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))

    return F.concat(
        _named(find(fixed.PYTHON_FUNCTION), "function", "function"),
        _named(find(fixed.PYTHON_CLASS), "class", "class"),
    )


def _script_symbols(content: Column) -> Column:
    """One pass for each pattern; the name is taken out of the short match afterwards."""

    def find(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))

    def name(match: Column) -> Column:
        declared = F.regexp_extract(match, fixed.SCRIPT_FUNCTION, 1)
        bound = F.regexp_extract(match, fixed.SCRIPT_FUNCTION, 2)
        return F.when(declared != "", declared).otherwise(bound)

    return F.concat(
        _named(F.transform(find(_SCRIPT_FUNCTION, 0), name), "function", "function"),
        _named(find(fixed.SCRIPT_CLASS, 1), "class", "class"),
    )


def _found(files: DataFrame) -> DataFrame:
    """Add `language` and the array `_ordered`: functions, then classes, each in text order.

    The steps are columns of their own so that no pattern runs twice on a text.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    language = F.col("language")
    found = (
        F.when(language == "go", _go_symbols(F.col("_declared")))
        .when(language == "python", _python_symbols(content))
        .when(language.isin("javascript", "typescript"), _script_symbols(content))
    )

    def of_kind(kind: str) -> Column:
        return F.filter("_found", lambda s: s["kind"] == kind)

    known = files.where(paths.language(F.col("path")).isin(*_WITH_SYMBOLS)).withColumn(
        "language", paths.language(F.col("path"))
    )
    return (
        declarations.with_declarations(known, F.when(language == "go", content), "_declared")
        .withColumn("_found", found)
        .withColumn("_ordered", F.concat(of_kind("function"), of_kind("class")))
        .drop("_declared", "_found")
    )


def with_symbols(files: DataFrame) -> DataFrame:
    """Files that declare symbols, with `language` and the array `symbols`.

    Java files pass the filter of analyzable extensions, but there is no
    extraction for them. A filter on the array would be pushed down to the scan
    and run the extraction a second time; exploding an array of no or one
    element drops the empty ones without that.
    """
    attached = _attach_methods(F.col("_ordered"))
    some = F.filter(F.array(attached), lambda a: F.size(a) > 0)
    found = _found(files)
    rest = [c for c in found.columns if c != "_ordered"]
    return found.select(*rest, F.explode(some).alias("symbols"))


def symbols(files: DataFrame, keep_content: bool = False) -> DataFrame:
    """Flat symbol table: one row per function or class, `ord` counting within the file."""
    rest = [c for c in files.columns if c not in ("content", "language")]
    kept = rest + ["language"] + (["content"] if keep_content else [])
    found = _found(files)
    each = F.posexplode(_attach_methods(F.col("_ordered"))).alias("ord", "symbol")
    return found.select(*kept, each).select(
        *kept,
        "ord",
        *[F.col(f"symbol.{c}") for c in ("kind", "type", "name", "line", "is_async", "args", "methods")],
    )


def symbol_numbers(files: DataFrame) -> DataFrame:
    """n_symbols of every file of a supported language, counted without making the symbols."""
    content, language = F.coalesce(F.col("content"), F.lit("")), F.col("language")

    def matches(*patterns: str) -> Column:
        return reduce(Column.__add__, [F.regexp_count(content, F.lit(pattern)) for pattern in patterns])

    known = files.where(paths.language(F.col("path")).isin(*_WITH_SYMBOLS)).withColumn(
        "language", paths.language(F.col("path"))
    )
    n = (
        F.when(language == "go", F.size("_declared"))
        .when(language == "python", matches(fixed.PYTHON_FUNCTION, fixed.PYTHON_CLASS))
        .otherwise(matches(_SCRIPT_FUNCTION, fixed.SCRIPT_CLASS))
    )
    found = declarations.with_declarations(known, F.when(language == "go", content), "_declared")
    rest = [c for c in files.columns if c not in ("content", "language")]
    return found.select(*rest, n.cast("long").alias("n_symbols"))


def functions(symbol_rows: DataFrame) -> DataFrame:
    return symbol_rows.where(F.col("kind") == "function").drop("methods")


def classes(symbol_rows: DataFrame) -> DataFrame:
    return symbol_rows.where(F.col("kind") == "class").drop("args", "is_async")


def semantic_changes(symbol_rows: DataFrame) -> DataFrame:
    """Change type and impact of a symbol; only Go symbols have them."""
    keys = [c for c in ("repo", "pr_id") if c in symbol_rows.columns]
    is_function = F.col("kind") == "function"
    return symbol_rows.where(F.col("language") == "go").select(
        *keys,
        F.when(is_function, "function_modified").otherwise("struct_modified").alias("type"),
        "name",
        F.col("path").alias("file"),
        F.when(is_function, "medium").otherwise("high").alias("impact"),
    )


def high_impact(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("impact").isin("high", "critical"))


def with_framework(symbol_rows: DataFrame, frameworks: dict[str, str]) -> DataFrame:
    """Add the test framework of the language, the default where it has none."""
    found = text.lookup(F.col("language"), frameworks, F.lit(fixed.DEFAULT_FRAMEWORK))
    return symbol_rows.withColumn("framework", found)


def with_framework_table(symbol_rows: DataFrame, frameworks: DataFrame) -> DataFrame:
    """The same for a table (language, framework); Spark picks the join by its size."""
    return symbol_rows.join(frameworks, "language", "left").fillna(
        fixed.DEFAULT_FRAMEWORK, ["framework"]
    )


def with_source(symbol_rows: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Join source text to symbols that come without it; '' where the file is missing."""
    texts = files.select(*keys, "path", "content")
    return symbol_rows.join(texts, [*keys, "path"], "left").fillna("", ["content"])
