"""Obsolete tests by what they call, also through helper functions.

Test files are cut at function headers next to their scan; what leaves it is one short row
per called name. A function is alive if it calls a symbol that exists or a function that
is alive. That is found backwards from the existing symbols: each round takes the callers
of what the last round has found, so no test is paired with all that it reaches, and there
are as many rounds as the longest chain of helpers. Calls of one very popular helper are
one side of a join whose other side has one row per name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import fixed, text
from changelens.session import pinned

_HEADER = r"(?md)^(?=[ \t]*(?:func|def)[ \t])"
_NAME = r"\A[ \t]*(?:func|def)[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)"
_CALL = r"(\w+)[ \t]*\("
_IS_TEST = r"^(?:Test|test_)"


def _functions(content: Column) -> Column:
    """name and calls (distinct names) of each function of a file."""
    chunks = F.filter(F.split(content, _HEADER, -1), lambda c: F.rlike(c, F.lit(_NAME)))
    known = F.array(*[F.lit(word) for word in fixed.NOT_CALLED])

    def function(chunk: Column) -> Column:
        name = F.regexp_extract(chunk, _NAME, 1)
        called = F.array_distinct(F.regexp_extract_all(chunk, F.lit(_CALL), F.lit(1)))
        return F.struct(name.alias("name"), F.filter(F.array_except(called, known), lambda c: c != name).alias("calls"))

    return F.transform(chunks, function)


def calls(files: DataFrame) -> DataFrame:
    """repo, caller and callee of all functions in test files (repo, content), distinct."""
    found = files.select("repo", F.explode(_functions(F.coalesce("content", F.lit("")))).alias("f"))
    return found.select("repo", F.col("f.name").alias("caller"), F.explode("f.calls").alias("callee")).distinct()


def alive_functions(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo and name of the functions that reach a symbol (repo, name). `edges` are pinned."""
    present = symbols.select("repo", F.col("name").alias("callee")).distinct()
    callers = [F.col("repo"), F.col("caller").alias("name")]
    alive = frontier = pinned(edges.join(present, ["repo", "callee"], "left_semi").select(*callers).distinct())
    while not frontier.isEmpty():
        reached = edges.join(frontier.withColumnRenamed("name", "callee"), ["repo", "callee"], "left_semi").select(*callers)
        frontier = pinned(reached.distinct().join(alive, ["repo", "name"], "left_anti"))
        alive = pinned(alive.union(frontier))
    return alive


def unreached_tests(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tests (repo, test_name) that call something and reach no symbol that exists. Tests
    without calls are not judged."""
    edges = pinned(calls(files))
    tests = edges.where(F.rlike("caller", F.lit(_IS_TEST))).select("repo", F.col("caller").alias("name")).distinct()
    return tests.join(alive_functions(edges, symbols), ["repo", "name"], "left_anti").select("repo", F.col("name").alias("test_name"))
