"""Texts of generated tests, files and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.text import capitalize, fill

FUNCTIONAL_HEADER = "// Functional test, written by a job"

FUNCTION_PROMPT = (
    "Write {language} tests for {name}.\n"
    "Cover valid input, boundary values and failures.\n"
    "Source:\n{source}\n"
)
FILE_PROMPT = (
    "Write {kind} tests for {path} ({language}).\n"
    "Cover valid input, boundary values and failures; keep tests independent.\n"
    "```{extension}\n{source}\n```\n"
)

HEADER = {
    "go": 'package main\n\nimport (\n\t"testing"\n)\n\n// Test framework: {framework}',
    "python": '"""Test framework: {framework}"""\n\nimport pytest',
    "javascript": "// Test framework: {framework}",
    "typescript": "// Test framework: {framework}",
}
_SCRIPT_HAPPY = (
    "test('{name} - happy path', () => {\n  expect({name}()).toBeDefined();\n});"
)
# A pair that is not listed has no skeleton.
FUNCTION = {
    "happy_path": {
        "go": (
            "func Test{Name}_HappyPath(t *testing.T) {\n"
            '\tif got := {name}(); got == nil {\n\t\tt.Error("no result")\n\t}\n}'
        ),
        "python": "def test_{name}_happy_path():\n    assert {name}() is not None",
        "javascript": _SCRIPT_HAPPY,
        "typescript": _SCRIPT_HAPPY,
    },
    "edge_case": {
        "go": 'func Test{Name}_EdgeCases(t *testing.T) {\n\tt.Skip("add boundary values")\n}',
        "python": 'def test_{name}_edge_cases():\n    pytest.skip("add boundary values")',
    },
    "error_handling": {
        "go": 'func Test{Name}_ErrorHandling(t *testing.T) {\n\tt.Skip("add failing input")\n}',
        "python": (
            "def test_{name}_error_handling():\n"
            "    with pytest.raises(Exception):\n        {name}(object())"
        ),
    },
}
METHOD = {
    "go": (
        "func Test{Owner}_{Method}(t *testing.T) {\n"
        "\tif got := (&{Owner}{}).{Method}(); got == nil {\n"
        '\t\tt.Error("no result")\n\t}\n}'
    ),
    "python": "def test_{Owner}_{method}():\n    assert {Owner}().{method}() is not None",
}
END_TO_END = 'func Test{Name}_E2E(t *testing.T) {\n\tt.Skip("add the complete workflow")\n}'
INTEGRATION = 'func Test{Name}_Integration(t *testing.T) {\n\tt.Skip("add module interaction")\n}'


def _by_language(language: Column, table: dict[str, str], **values: Column) -> Column:
    result = F.lit("")
    for name, template in table.items():
        result = F.when(language == name, fill(template, **values)).otherwise(result)
    return result


def file_header(language: Column, framework: Column) -> Column:
    return _by_language(language, HEADER, framework=framework)


def comment_mark(language: Column) -> Column:
    return F.when(language == "python", "#").otherwise("//")


def function_code(kind: str, language: Column, name: Column) -> Column:
    return _by_language(language, FUNCTION[kind], name=name, Name=capitalize(name))


def method_code(language: Column, owner: Column, method: Column) -> Column:
    return _by_language(language, METHOD, Owner=owner, method=method, Method=capitalize(method))


def end_to_end_code(name: Column) -> Column:
    return fill(END_TO_END, Name=capitalize(name))


def integration_code(module: Column) -> Column:
    return fill(INTEGRATION, Name=capitalize(module))
