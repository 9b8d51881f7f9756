"""Input tables derived from the driver's tables.

Every view covers all rows of its table and keeps whole texts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import fixed, paths, text
from changelens.functions.text import capitalize, fill, lookup

# Extension by the identifier's remainder.
EXTENSIONS = [".go", ".py", ".js", ".ts", ".java", ".rb", ".md", ""]
HEADERS = {
    ".go": (
        "package p{id}\n\ntype T{id} struct {\n\tn int\n}\n\n"
        "func (t *T{id}) Get{id}(a, b int) int {\n\treturn a + b\n}\n\n"
        "func New{id}() *T{id} {\n\treturn &T{id}{}\n}\n"
    ),
    ".py": (
        "import os\n\ndef load_{id}(a, b):\n    return a + b\n\n"
        "class Model{id}:\n    def run(self):\n        return 1\n\n"
    ),
    ".js": "function f{id}(x) {\n  return x;\n}\nconst g{id} = async (x) => x;\nclass C{id} {\n}\n",
    ".ts": "export function f{id}(x) {\n  return x;\n}\nlet g{id} = function (x) { return x; };\n",
}
# A file header whose declarations are nested, grouped and broken over lines, and what it declares:
# kind, name, line, arguments, methods.
NESTED_HEADER = (
    "package p{id}\n// func Commented{id}() {}\n/* type Blocked{id} struct {\n}\n*/\nvar raw = `\nfunc Raw{id}() {}\n`\n"
    "type (\n\tInner{id} struct {\n\t\tpart struct{ deep int }\n\t}\n\tPair{id}[K comparable] struct{ key K }\n\tFixed{id} [5]struct{}\n)\n"
    "func Call{id}(cb func(int, string) (a, b error), n int) {\n\ttype Local{id} struct{ q int }\n}\n"
    "func\n(x *Inner{id})\nOpen{id}(\n\tsize int,\n\tdone func(left, right int) bool,\n) {}\n"
)
NESTED_DECLARATIONS = (
    ("function", "Call{id}", 16, "cb,n", ""),
    ("function", "Open{id}", 19, "size,done", ""),
    ("class", "Inner{id}", 10, "", "Open{id}"),
    ("class", "Pair{id}", 13, "", ""),
    ("class", "Local{id}", 17, "", ""),
)
ROOT_MARKERS = {"0": "go.mod", "1": "setup.py", "2": "package.json", "3": "pyproject.toml"}


class Views:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @staticmethod
    def _ext(number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (number % 8).cast("int") + 1)

    @staticmethod
    def _repo(number: Column) -> Column:
        return F.concat(F.lit("repo"), (number % 10).cast("string"))

    @cached_property
    def _code_files(self) -> DataFrame:
        ident = "cast(doc_id AS STRING)"
        header = " ".join(
            f"WHEN '{extension}' THEN replace('{template}', '{{id}}', {ident})"
            for extension, template in HEADERS.items()
        )
        listed = ", ".join(f"'{extension}'" for extension in EXTENSIONS)
        return (
            self.table("documents")
            .selectExpr("*", f"element_at(array({listed}), cast(doc_id % 8 AS INT) + 1) AS ext")
            .selectExpr(
                "doc_id",
                "concat('repo', cast(doc_id % 10 AS STRING)) AS repo",
                "doc_id % 100 AS pr_id",
                f"concat(if(doc_id % 13 = 0, '', concat(source, '/', lang, '/')), 'f', {ident}, ext) AS path",
                f"concat(CASE ext {header} ELSE '' END, text) AS content",
            )
        )

    def code_files(self) -> DataFrame:
        """doc_id, repo, pr_id, path, content; one source file per document."""
        return self._code_files

    def nested_sources(self) -> DataFrame:
        """doc_id, repo, path, content: Go files with nested declarations before the document's text."""
        ident = F.col("doc_id").cast("string")
        return self.table("documents").select(
            "doc_id", self._repo(F.col("doc_id")).alias("repo"), F.concat(F.lit("n"), ident, F.lit(".go")).alias("path"),
            F.concat(fill(NESTED_HEADER, id=ident), F.col("text")).alias("content"),
        )

    def base_files(self) -> DataFrame:
        return self.code_files().where(F.col("doc_id") % 10 != 9).select("repo", "path", "content")

    def _head(self) -> DataFrame:
        body = F.col("content")
        rest = F.substring(body, F.instr(body, "\n") + 1, F.length(body))
        edited = F.concat(rest, F.lit("\nadded "), F.col("doc_id").cast("string"))
        files = self.code_files().where(F.col("doc_id") % 10 != 8)
        return files.withColumn("content", F.when(F.col("doc_id") % 4 == 0, edited).otherwise(body))

    def head_files(self) -> DataFrame:
        return self._head().select("repo", "path", "content")

    def moved_files(self) -> DataFrame:
        """The head snapshot with files moved to another folder, some of them edited, some copied there."""
        n, path, body = F.col("doc_id"), F.col("path"), F.col("content")
        edited = F.when(n % 12 == 7, F.concat(body, F.lit("\nmoved"))).otherwise(body)
        moved = F.concat(F.lit("moved/"), path)
        places = F.when(n % 6 == 1, F.array(moved)).when(n % 60 == 2, F.array(path, moved)).otherwise(F.array(path))
        return self._head().select("repo", F.explode(places).alias("path"), edited.alias("content"))

    def line_profiles(self) -> DataFrame:
        """repo, pr_id, tool, body: a coverage profile per head file, in the format of its tool."""
        n, path, lines = F.col("doc_id"), F.col("path"), F.size(text.lines(F.col("content")))

        def numbers(count: Column, keep) -> Column:
            return F.filter(F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>")), keep)

        def block(i: Column) -> Column:
            first, hits = 4 * i - 3, (n + i - 1) % 3
            return F.format_string("%s:%d.1,%d.9 2 %d", path, first, first + 2, hits)

        def listed(rest: int) -> Column:
            return F.array_join(F.transform(numbers(lines, lambda i: (i + n) % 3 == rest), lambda i: i.cast("string")), ", ")

        blocks = F.array_join(F.transform(numbers(F.ceil(lines / 4).cast("int"), lambda i: i > 0), block), "\n")
        lists = F.concat(
            F.lit('{"files": {"'), path, F.lit('": {"executed_lines": ['), listed(0), F.lit('], "missing_lines": ['), listed(1), F.lit("]}}}")
        )
        records = F.transform(numbers(lines, lambda i: i % 5 > 0), lambda i: F.format_string("DA:%d,%d", i, (i + n) % 2))
        trace = F.concat(F.lit("TN:\nSF:"), path, F.lit("\n"), F.array_join(records, "\n"), F.lit("\nend_of_record\n"))
        tool = lookup(paths.extension(path), {".go": "go", ".py": "python", ".js": "javascript", ".ts": "javascript"}, F.lit("none"))
        body = F.when(F.col("tool") == "go", F.concat(F.lit("mode: count\n"), blocks)).when(F.col("tool") == "python", lists).otherwise(trace)
        files = self._head().withColumn("tool", tool).where(F.col("tool") != "none")
        return files.select("repo", "pr_id", "tool", body.alias("body"))

    def name_status(self) -> DataFrame:
        """doc_id, repo, pr_id, line: the change list."""
        last = F.col("doc_id") % 10
        path = F.col("path")
        return self.code_files().select(
            "doc_id",
            "repo",
            "pr_id",
            F.when(last == 9, F.concat(F.lit("A\t"), path))
            .when(last == 8, F.concat(F.lit("D\t"), path))
            .when(last == 7, F.concat(F.lit("R100\told/"), path, F.lit("\t"), path))
            .otherwise(F.concat(F.lit("M\t"), path))
            .alias("line"),
        )

    def patches(self) -> DataFrame:
        n = F.col("doc_id")
        more = F.when(n % 3 == 0, F.lit("+second\n")).otherwise("")
        diff = F.concat(
            F.lit("--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"),
            F.lit("\n@@ -1,2 +1,2 @@\n context\n-before\n+after\n"), more,
        )
        return self.code_files().select("repo", "pr_id", "path", diff.alias("diff"))

    def pr_files(self) -> DataFrame:
        part = F.col("l_partkey")
        status = lookup(F.col("l_returnflag"), {"A": "A", "N": "M", "R": "D"}, F.lit("M"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("pr_id"),
            self._repo(F.col("l_orderkey")).alias("repo"),
            F.col("l_linenumber").alias("seq"),
            F.concat(
                F.lit("m"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/f"),
                part.cast("string"), self._ext(part),
            ).alias("path"),
            status.alias("status"),
            F.col("l_quantity").cast("int").alias("lines_changed"),
        )

    def pull_requests(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("pr_id"),
            self._repo(key).alias("repo"),
            F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("https://example.org/pull/"), key.cast("string")).alias("pr_url"),
        )

    def generated_tests(self) -> DataFrame:
        """repo, path, name, kind, ord: one row per file and kind."""
        n = F.col("doc_id")
        kinds = F.array(*[F.lit(suffix) for _, suffix, _ in fixed.FUNCTION_KINDS])
        stem = F.concat(F.lit("Test"), capitalize(F.concat(F.lit("load_"), n.cast("string"))))
        return self.code_files().select(
            "repo", self._test_path().alias("path"), stem.alias("stem"), F.posexplode(kinds).alias("ord", "kind")
        ).select("repo", "path", F.concat("stem", "kind").alias("name"), "kind", "ord")

    @staticmethod
    def _test_path() -> Column:
        """Test path beside a source; some files keep a name that is no test's."""
        return F.when(F.col("doc_id") % 7 == 3, F.col("path")).otherwise(paths.test_path_beside(F.col("path")))

    def generated_files(self) -> DataFrame:
        """repo, path, content: the generated tests of a path as one file."""
        ident = F.col("doc_id").cast("string")
        block = (
            "func TestLoad_{id}{kind}(t *testing.T) {\n\tload_{id}(1, 2)\n}\n\n"
        )
        blocks = [
            fill(block.replace("{kind}", suffix), id=ident) for _, suffix, _ in fixed.FUNCTION_KINDS
        ]
        return (
            self.code_files()
            .select("repo", self._test_path().alias("path"), F.concat(F.lit("package main\n\n"), *blocks).alias("content"))
        )

    def existing_tests(self) -> DataFrame:
        """repo, path, content: the suite; the document's text follows the tests."""
        n = F.col("doc_id")
        kind = F.when(n % 3 == 0, "_HappyPath").otherwise("_Other")
        body = fill(
            "package suite\n\nfunc TestLoad_{id}{kind}(t *testing.T) {\n\tfor {\n\t\tload_{id}(1, 2)\n\t}\n}\n\n"
            "func TestRemoved_{id}_HappyPath(t *testing.T) {}\n"
            "def test_load_{id}_extra(a):\n    assert a\ndef test_load_{id}_last():\n    assert load_{id}(1, 2)\n\n{text}",
            id=n.cast("string"),
            kind=kind,
            text=F.col("content"),
        )
        return (
            self.code_files()
            .where(n % 5 != 0)
            .select("repo", self._test_path().alias("path"), body.alias("content"))
        )

    def helper_tests(self) -> DataFrame:
        """repo, path, content: test files whose tests go through helpers; the document's text follows."""
        body = fill(
            "package suite\n\nfunc TestDeep_{id}(t *testing.T) {\n\tcheck_{id}(t)\n}\n\nfunc check_{id}(t *testing.T) {\n"
            "\tif (true) { verify_{id} (t, 1) }\n}\n\nfunc verify_{id}(t *testing.T, n int) {\n\tload_{id}(n, 2)\n}\n\n"
            "func TestRound_{id}(t *testing.T) {\n\tping_{id}()\n}\nfunc ping_{id}() { pong_{id}() }\nfunc pong_{id}() { ping_{id}() }\n"
            "func TestNext_{id}(t *testing.T) {\n\tcheck_{next}(t)\n}\nfunc TestNothing_{id}(t *testing.T) {}\n"
            "def test_direct_{id}():\n    assert load_{id}(1, 2)\n{text}",
            id=F.col("doc_id").cast("string"), next=(F.col("doc_id") + 10).cast("string"), text=F.col("text"),
        )
        n = F.col("doc_id")
        return self.table("documents").select(
            self._repo(n).alias("repo"), F.concat(F.lit("t"), n.cast("string"), F.lit("_test.go")).alias("path"), body.alias("content")
        )

    def coverage_runs(self) -> DataFrame:
        run = F.col("event_id")
        return self.table("events").select(
            run.alias("run_id"),
            run.alias("pr_id"),
            self._repo(run).alias("repo"),
            F.col("user_id").alias("repo_key"),
            "ts",
            F.when(F.col("event_type") == "view", "baseline").otherwise("pr").alias("kind"),
            F.least(F.col("value"), F.lit(100.0)).alias("pct"),
        )

    def coverage_logs(self) -> DataFrame:
        """coverage_runs with the log text of each tool; some Go logs have a total only."""
        pct = F.col("pct").cast("decimal(10,2)").cast("string")
        line = F.concat(F.lit("ok  \tpkg/a\t0.1s\tcoverage: "), pct, F.lit("% of statements\n"))
        first = F.when(F.col("run_id") % 5 == 0, F.lit("?   \tpkg/a\t[no test files]\n")).otherwise(line)
        return self.coverage_runs().withColumns(
            {
                "go_log": F.concat(
                    first, F.lit("total:\t(statements)\t1.00%\ntotal:\t(statements)\t"), pct, F.lit("%\n")
                ),
                "js_log": F.concat(
                    F.lit("File | % Stmts | % Branch | % Funcs | % Lines |\nAll files | 1 | 2 | 3 | "),
                    pct,
                    F.lit(" |\n"),
                ),
                "py_log": F.concat(F.lit("Name Stmts Miss Cover\na.py 1 0 100%\nTOTAL 9 3 "), pct, F.lit("%\n")),
                "project_type": lookup(
                    (F.col("run_id") % 4).cast("string"),
                    {"0": "go", "1": "python", "2": "javascript"},
                    F.lit(fixed.UNKNOWN_PROJECT),
                ),
            }
        )

    def coverage_json(self) -> DataFrame:
        pct = F.col("pct").cast("decimal(10,2)").cast("string")
        slot = F.col("run_id") % 3
        return self.coverage_runs().select(
            "run_id",
            F.when(slot == 0, "cache").when(slot == 1, "python").otherwise("javascript").alias("tool"),
            F.when(slot == 0, F.concat(F.lit('{"coverage": '), pct, F.lit(', "timestamp": "t"}')))
            .when(slot == 1, F.concat(F.lit('{"totals": {"percent_covered": '), pct, F.lit("}}")))
            .otherwise(F.concat(F.lit('{"total": {"lines": {"pct": '), pct, F.lit("}}}")))
            .alias("body"),
        )

    def model_responses(self) -> DataFrame:
        """conv_id, turn, repo, body: stored answers as JSON documents."""

        def block(kind: str, body: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), body.alias("text"))

        text = F.col("text")
        fence = F.concat(F.lit("\n```go\nx := "), F.col("turn").cast("string"), F.lit("\n```\n"))
        usage = F.struct(
            F.length(text).alias("input_tokens"), (F.length(text) * 2).alias("output_tokens")
        )
        return (
            self.table("conversations")
            .where(F.col("role") == "assistant")
            .select(
                "conv_id",
                "turn",
                self._repo(F.col("conv_id")).alias("repo"),
                F.to_json(
                    F.struct(
                        F.array(
                            block("text", text), block("note", F.lit("skip")), block("text", fence)
                        ).alias("content"),
                        usage.alias("usage"),
                    )
                ).alias("body"),
            )
        )

    def fenced_answers(self) -> DataFrame:
        """doc_id, r: the whole text inside one fence."""
        return self.table("documents").select(
            "doc_id",
            F.concat(F.lit("Here it is\n```text\n"), F.col("text"), F.lit("\n```\nDone")).alias("r"),
        )

    def root_files(self) -> DataFrame:
        """repo, path: all code files and marker files at the roots of some repositories."""
        marker = lookup((F.col("doc_id") % 10).cast("string"), ROOT_MARKERS, F.lit("README.md"))
        files = self.code_files()
        return files.select("repo", "path").unionByName(files.select("repo", marker.alias("path")))
