"""Path expressions: base name, extension, language, module, test file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions import fixed
from changelens.functions.text import lookup

EXTENSION_BY_LANGUAGE = {
    language: extension
    for extension, language in fixed.LANGUAGE_BY_EXTENSION.items()
    if language in fixed.TESTABLE_LANGUAGES
}
SHORT_LANGUAGES = {extension: language for language, extension in EXTENSION_BY_LANGUAGE.items()}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Directory of a path, '.' when it has none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """Extension of the base name with its dot, '' when it has none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def language(path: Column) -> Column:
    return lookup(
        F.lower(extension(path)), fixed.LANGUAGE_BY_EXTENSION, F.lit(fixed.UNKNOWN_LANGUAGE)
    )


def test_language(path: Column) -> Column:
    """One of the five testable languages; the default stands for the rest."""
    return lookup(F.lower(extension(path)), SHORT_LANGUAGES, F.lit(fixed.DEFAULT_TEST_LANGUAGE))


def display_language(path: Column) -> Column:
    """Language name for people; the raw extension where there is no name."""
    raw = F.substring_index(path, ".", -1)
    return lookup(raw, fixed.DISPLAY_LANGUAGE, raw)


def language_extension(lang: Column) -> Column:
    default = EXTENSION_BY_LANGUAGE[fixed.DEFAULT_TEST_LANGUAGE]
    return lookup(lang, EXTENSION_BY_LANGUAGE, F.lit(default))


def module(path: Column) -> Column:
    """First directory of a path, null for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))


def is_analyzable(path: Column) -> Column:
    return F.lower(extension(path)).isin(*fixed.ANALYZABLE_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    base = base_name(path)
    return (
        F.endswith(base, F.lit("_test.go"))
        | F.startswith(base, F.lit("test_"))
        | F.contains(base, F.lit(".test."))
    )


def is_functional_test(path: Column) -> Column:
    return F.contains(base_name(path), F.lit("functional"))


def matches_test_globs(path: Column) -> Column:
    """Base name of the form *_test.*, test_*.* or *.test.*."""
    return F.rlike(base_name(path), F.lit(r"_test\.|^test_.*\.|\.test\."))


def mentions_test(path: Column) -> Column:
    return F.contains(base_name(path), F.lit("test"))


def is_skipped(path: Column) -> Column:
    return F.rlike(path, F.lit(fixed.SKIPPED_PATHS))


def is_functional_candidate(path: Column) -> Column:
    return F.rlike(path, F.lit(fixed.FUNCTIONAL_CANDIDATES))


def flat_test_name(path: Column, lang: Column) -> Column:
    """Unit-test file name that does not keep the directory."""
    name = stem(path)
    return (
        F.when(lang == "go", F.concat(name, F.lit("_test.go")))
        .when(lang == "python", F.concat(F.lit("test_"), name, F.lit(".py")))
        .otherwise(F.concat(F.lit("test_"), name, language_extension(lang)))
    )


def test_path_beside(path: Column, kind: str = "unit") -> Column:
    """Test path in the directory of the source; other kinds get a folder of their own."""
    name = stem(path)
    ext = F.substring_index(base_name(path), ".", -1)
    file = (
        F.when(ext == "go", F.concat(name, F.lit("_test.go")))
        .when(ext == "py", F.concat(F.lit("test_"), name, F.lit(".py")))
        .when(ext.isin("js", "ts"), F.concat(name, F.lit(".test."), ext))
        .when(ext == "java", F.concat(name, F.lit("Test.java")))
        .otherwise(F.concat(name, F.lit("_test."), ext))
    )
    beside = F.concat_ws("/", dir_name(path), file)
    return beside if kind == "unit" else F.concat(F.lit(kind + "/"), beside)


def functional_test_name(symbol: Column, lang: Column) -> Column:
    return F.concat(F.lit("test_"), symbol, F.lit("_functional"), language_extension(lang))


def integration_test_name(mod: Column) -> Column:
    return F.concat(F.lit("test_"), mod, F.lit("_integration_test.go"))


def relative_to(path: Column, root: str) -> Column:
    """Path below a root directory."""
    pattern = "^.*?" + "".join("\\" + ch if not ch.isalnum() and ch not in "/_" else ch for ch in root.rstrip("/"))
    return F.regexp_replace(path, pattern + "/", "")
