"""The names, suffixes and patterns that results depend on."""

# Language of a lower-cased file extension.
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
}
UNKNOWN_LANGUAGE = "unknown"

# The five languages that tests can be generated for.
TESTABLE_LANGUAGES = ("go", "python", "javascript", "typescript", "java")
DEFAULT_TEST_LANGUAGE = "go"
ANALYZABLE_EXTENSIONS = (".go", ".py", ".js", ".ts", ".java")

# Display name of an extension without its dot.
DISPLAY_LANGUAGE = {
    "go": "Go",
    "py": "Python",
    "js": "JavaScript/TypeScript",
    "ts": "JavaScript/TypeScript",
    "jsx": "JavaScript/TypeScript",
    "tsx": "JavaScript/TypeScript",
    "java": "Java",
}

# Test framework of a language.
FRAMEWORKS = {
    "go": "testing",
    "python": "pytest",
    "javascript": "jest",
    "typescript": "jest",
    "java": "junit",
}
EXTRA_FRAMEWORKS = {"ruby": "rspec", "php": "phpunit"}
DEFAULT_FRAMEWORK = "testing"

# Project type of a marker file at the repository root, first match wins.
PROJECT_MARKERS = (
    ("go.mod", "go"),
    ("setup.py", "python"),
    ("pyproject.toml", "python"),
    ("package.json", "javascript"),
)
# The order used by the path-rule profile.
PATH_RULE_MARKERS = (
    ("go.mod", "go"),
    ("package.json", "javascript"),
    ("requirements.txt", "python"),
    ("setup.py", "python"),
)
UNKNOWN_PROJECT = "unknown"

# Test kinds of a function, with name suffix and description ending.
FUNCTION_KINDS = (
    ("happy_path", "_HappyPath", "with valid inputs"),
    ("edge_case", "_EdgeCases", "with edge case inputs"),
    ("error_handling", "_ErrorHandling", "error handling"),
)
EDGE_KIND = "edge_case"

# Endings of generated test names.
TEST_NAME_ENDINGS = (
    "_HappyPath",
    "_EdgeCases",
    "_ErrorHandling",
    "_E2E",
    "_Integration",
    "_happy_path",
    "_edge_cases",
    "_error_handling",
)

# Words before a parenthesis that are no call.
NOT_CALLED = ("and", "assert", "def", "elif", "for", "func", "if", "in", "not", "or", "return", "switch", "while")

# Share of changed lines taken as covered when symbols changed.
COVERED_SHARE = 0.7

# Path rules.
SKIPPED_PATHS = r"_test\.|\.test\.|\.(md|txt|json|yaml|yml)$|^(docs|documentation)/"
FUNCTIONAL_CANDIDATES = "(api|service|handler|controller)"

# Declaration patterns. (?md): ^ matches after a newline only.
PYTHON_FUNCTION = r"(?md)^def\s+(\w+)\s*\("
PYTHON_CLASS = r"(?md)^class\s+(\w+)"
SCRIPT_FUNCTION = (
    r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?"
    r"(?:function|\([^)]*\)\s*=>))"
)
SCRIPT_CLASS = r"class\s+(\w+)"

# Include and exclude globs of the generation rules.
INCLUDE_GLOBS = ("*.go", "*.py", "*.js", "*.ts", "*.java")
EXCLUDE_GLOBS = (
    "*_test.go",
    "test_*.py",
    "*.test.js",
    "*.spec.ts",
    "vendor/*",
    "node_modules/*",
    ".git/*",
)

# Pull-request event kinds that start a run.
RUN_EVENT_KINDS = ("opened", "synchronize", "reopened")
