"""Test deduplication: which generated tests the existing suites already hold.

Names and blocks are taken out of the generated files next to their scan, and so
are the mentions of the existing ones: what stands behind each `Test` or `test_`
up to the next white space. A test name begins with one of these and holds no white
space, so a text contains it exactly if a mention begins with it. Names and mentions
meet as short rows of one path, in sorted order: of all mentions from a name on, the
first begins with it if any does. No text of a suite is shuffled to answer which tests
are new; texts are joined only where the merged file itself is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import fixed, paths, text

PATH_KEYS = ("repo", "path")
SEPARATOR = "\n// Tests added by a job\n\n"

_GO_START = "func Test"
_PY_START = "def test_"
_MENTION = r"(?=((?:Test|test_)\S*))"
_IS_MENTION = r"^(?:Test|test_)\S*$"
_BLOCK_START = r"(?md)^(?=[^\S\n]*(?:func Test|def test_))"
_GO_BLOCK = r"(?sd)\A(.*?\n[^\S\n]*\}[^\S\n]*\n)"
_GO_BLOCK_UNINDENTED = r"(?sd)\A(.*?\n\}[^\S\n]*\n)"
_PY_BLOCK = r"(?sd)\A(.*?\n[^\S\n]*\}?[^\S\n]*\n)"


def _starts_test(line: Column) -> Column:
    return F.startswith(line, F.lit(_GO_START)) | F.startswith(line, F.lit(_PY_START))


def _header_name(line: Column, go_suffixes: tuple[str, ...], py_suffixes: tuple[str, ...]) -> Column:
    def cut(word: Column, suffixes: tuple[str, ...]) -> Column:
        for suffix in suffixes:
            word = text.trim_suffix(word, suffix)
        return word

    word = text.field(line, 1)
    return F.when(F.startswith(line, F.lit(_GO_START)), cut(word, go_suffixes)).when(
        F.startswith(line, F.lit(_PY_START)), cut(word, py_suffixes)
    )


def test_names(content: Column) -> Column:
    """Array of the test names of a test file, in text order, repeats kept."""
    headers = F.filter(F.transform(text.lines(content), text.trim_space), _starts_test)
    return F.transform(headers, lambda line: _header_name(line, ("(t", "("), ("():", ":")))


def block_name(block: Column) -> Column:
    """Test name on the first line of a block, '' when there is none."""
    line = text.trim_space(F.substring_index(block, "\n", 1))
    return F.coalesce(_header_name(line, ("(t",), ("():",)), F.lit(""))


def test_blocks(content: Column, unindented: bool = False) -> Column:
    """Array of the test functions of a test file.

    A block begins at a test header and ends at the first line that is only a
    closing brace, for Python also at the first blank line, or else before the
    next header. `unindented` accepts a brace in the first column only, which
    keeps nested blocks whole.
    """
    chunks = F.filter(
        F.split(F.concat(content, F.lit("\n")), _BLOCK_START, -1),
        lambda c: F.rlike(c, F.lit(r"\A\s*(?:func Test|def test_)")),
    )

    def block(chunk: Column) -> Column:
        is_python = F.rlike(chunk, F.lit(r"\A\s*def test_"))
        go_end = _GO_BLOCK_UNINDENTED if unindented else _GO_BLOCK
        ended = F.when(is_python, F.regexp_extract(chunk, _PY_BLOCK, 1)).otherwise(
            F.regexp_extract(chunk, go_end, 1)
        )
        return F.when(ended != "", ended).otherwise(chunk)

    return F.transform(chunks, block)


def exploded_names(files: DataFrame) -> DataFrame:
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.explode(test_names(F.col("content"))).alias("test_name"))


def exploded_blocks(files: DataFrame, unindented: bool = False) -> DataFrame:
    keep = [c for c in files.columns if c != "content"]
    blocks = test_blocks(F.col("content"), unindented)
    return files.select(*keep, F.posexplode(blocks).alias("block_no", "block")).withColumn(
        "test_name", block_name(F.col("block"))
    )


def generated_tests_only(generated: DataFrame) -> DataFrame:
    """Generated files that are test files by their name; no other is integrated."""
    return generated.where(paths.is_test_file(F.col("path")))


def matched_paths(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Every generated test path and whether the suite has a file there."""
    known = existing.select(*PATH_KEYS, F.lit(True).alias("path_exists"))
    return generated_tests_only(generated).select(*PATH_KEYS).join(known, list(PATH_KEYS), "left").fillna(
        False, ["path_exists"]
    )


def mentions(content: Column) -> Column:
    """Distinct stretches without white space that begin with a test prefix, from any place."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(_MENTION), F.lit(1)))


def contained_names(names: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows (repo, path, name) of which the existing file at the path contains the name.
    Names are distinct, begin with a test prefix and hold no white space."""
    asked = names.select(*PATH_KEYS, F.col("name").alias("text"), F.lit(True).alias("is_name"))
    held = existing.select(*PATH_KEYS, F.explode(mentions(F.col("content"))).alias("text"), F.lit(False).alias("is_name"))
    # Names and mentions of one file; mentions that equal a name come behind it.
    behind = Window.partitionBy(*PATH_KEYS).orderBy("text", F.col("is_name").desc()).rowsBetween(0, Window.unboundedFollowing)
    following = F.first(F.when(~F.col("is_name"), F.col("text")), ignorenulls=True).over(behind)
    met = asked.union(held).withColumn("following", following)
    return met.where(F.col("is_name") & F.startswith("following", F.col("text"))).select(*PATH_KEYS, F.col("text").alias("name"))


def _block_names(content: Column, unindented: bool = False) -> Column:
    return F.filter(F.transform(test_blocks(content, unindented), block_name), lambda name: name != "")


def _compared(generated: DataFrame, existing: DataFrame, unindented: bool = False) -> DataFrame:
    """Per generated test file: names, block_names (arrays), path_exists and present (the
    names among both that the existing file contains)."""
    files = generated_tests_only(generated).select(
        *PATH_KEYS, test_names(F.col("content")).alias("names"), _block_names(F.col("content"), unindented).alias("block_names")
    )
    every = F.array_distinct(F.concat("names", "block_names"))
    asked = files.select(*PATH_KEYS, F.explode(every).alias("name"))
    found = contained_names(asked, existing).groupBy(*PATH_KEYS).agg(F.collect_set("name").alias("present"))  # names of one file
    known = existing.select(*PATH_KEYS, F.lit(True).alias("path_exists"))
    none = F.array().cast("array<string>")
    return (
        files.join(known, list(PATH_KEYS), "left")
        .join(found, list(PATH_KEYS), "left")
        .withColumns({"path_exists": F.coalesce("path_exists", F.lit(False)), "present": F.coalesce("present", none)})
        .withColumn("is_duplicate", F.arrays_overlap("names", "present"))
    )


def duplicate_files(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Generated files of which at least one test name occurs in the existing file."""
    names = generated_tests_only(generated).select(*PATH_KEYS, F.explode(F.array_distinct(test_names(F.col("content")))).alias("name"))
    return contained_names(names, existing).select(*PATH_KEYS).distinct()


def new_tests(tests: DataFrame, existing: DataFrame, any_name: bool = False) -> DataFrame:
    """Generated tests (repo, path, name) that do not occur in the existing file.

    A name that is part of another name counts as present. `any_name` admits names that
    are no test names; these are looked for in the texts themselves."""
    names = tests.select(*PATH_KEYS, "name").distinct()
    if not any_name:
        return tests.join(contained_names(names, existing), [*PATH_KEYS, "name"], "left_anti")
    plain = F.rlike("name", F.lit(_IS_MENTION))
    e = existing.select(F.col("repo").alias("e_repo"), F.col("path").alias("e_path"), "content")
    within = (F.col("repo") == F.col("e_repo")) & (F.col("path") == F.col("e_path")) & F.contains(F.col("content"), F.col("name"))
    found = contained_names(names.where(plain), existing).union(names.where(~plain).join(e, within, "left_semi"))
    return tests.join(found, [*PATH_KEYS, "name"], "left_anti")


def new_tests_exact(tests: DataFrame, existing: DataFrame) -> DataFrame:
    """The same by whole names; a plain anti join."""
    names = exploded_names(existing).select(*PATH_KEYS, F.col("test_name").alias("name")).distinct()
    return tests.join(names, [*PATH_KEYS, "name"], "left_anti")


def test_name_difference(tests: DataFrame, existing: DataFrame) -> DataFrame:
    """Generated minus existing names as bags."""
    names = exploded_names(existing).select(*PATH_KEYS, F.col("test_name").alias("name"))
    return tests.select(*PATH_KEYS, "name").exceptAll(names)


def _added_text(blocks: Column, present: Column) -> Column:
    """The blocks whose name is not present, each followed by an empty line."""
    kept = F.filter(blocks, lambda b: (block_name(b) != "") & ~F.array_contains(present, block_name(b)))
    return F.array_join(F.transform(kept, lambda b: F.concat(b, F.lit("\n\n"))), "")


def integrate_files(
    generated: DataFrame, existing: DataFrame, per_test: bool = False, unindented: bool = False
) -> DataFrame:
    """The suite after integration, with the action taken per path.

    A path the suite lacks is copied. A duplicate file is skipped as a whole;
    with `per_test` its new tests are merged all the same. The existing texts are joined
    with what is added to them, the generated ones only with short rows.
    """
    keys = list(PATH_KEYS)
    compared = _compared(generated, existing, unindented)
    known = compared.where("path_exists")
    skipped = F.lit(False) if per_test else F.col("is_duplicate")
    actions = known.select(*keys, "present", F.when(skipped, "skipped").otherwise("merged").alias("action"))
    sources = generated_tests_only(generated).select(*keys, test_blocks(F.col("content"), unindented).alias("blocks"))
    added = sources.join(actions, keys).select(
        *keys, "action", F.when(F.col("action") == "merged", _added_text(F.col("blocks"), F.col("present"))).otherwise("").alias("added")
    )
    merged = existing.select(*keys, "content").join(added, keys, "left").select(
        *keys,
        F.coalesce("action", F.lit("kept")).alias("action"),
        F.when(F.coalesce("added", F.lit("")) == "", F.col("content"))
        .otherwise(F.concat("content", F.lit(SEPARATOR), "added"))
        .alias("content"),
    )
    copied = generated_tests_only(generated).select(*keys, F.lit("copied").alias("action"), "content").join(
        existing.select(*keys), keys, "left_anti"
    )
    return merged.union(copied)


def integration_stats(
    generated: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("repo",)
) -> DataFrame:
    """Files integrated, duplicates skipped and tests added."""
    fresh = F.size(F.filter("block_names", lambda name: ~F.array_contains(F.col("present"), name)))
    added = F.when(F.col("path_exists"), fresh).otherwise(F.size("names"))
    return (
        _compared(generated, existing)
        .withColumn("n_added", F.when(F.col("is_duplicate"), 0).otherwise(added))
        .groupBy(*keys)
        .agg(
            F.count_if(~F.col("is_duplicate")).alias("files_integrated"),
            F.count_if(F.col("is_duplicate")).alias("duplicates_skipped"),
            F.sum("n_added").alias("tests_added"),
        )
    )


def tested_symbols(test_name: Column) -> Column:
    """Symbols a test name may stand for: the name without its prefix, without a known
    ending, and up to its last underscore."""
    endings = "|".join(fixed.TEST_NAME_ENDINGS)
    patterns = (r"^(?:Test|test_)(.+)$", rf"^(?:Test|test_)(.+?)(?:{endings})$", r"^(?:Test|test_)(.+)_[^_]*$")
    found = F.array(*[F.regexp_extract(test_name, pattern, 1) for pattern in patterns])
    return F.array_distinct(F.filter(found, lambda name: name != ""))


def obsolete_tests(existing_names: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Tests (repo, test_name) none of whose possible symbols exists in the head snapshot.

    Both sides are compared with the first letter upper-cased. A name that is only a
    prefix stands for nothing and is not judged.
    """
    candidates = tested_symbols(F.col("test_name"))
    present = symbol_rows.select("repo", text.capitalize(F.col("name")).alias("symbol_key")).distinct()
    alive = (
        existing_names.select("repo", "test_name")
        .distinct()
        .select("repo", "test_name", F.explode(candidates).alias("symbol"))
        .select("repo", "test_name", text.capitalize(F.col("symbol")).alias("symbol_key"))
        .join(present, ["repo", "symbol_key"], "left_semi")
        .select("repo", "test_name")
        .distinct()
    )
    return existing_names.where(F.size(candidates) > 0).join(alive, ["repo", "test_name"], "left_anti")
