import random
import time

from pyspark.sql import functions as F

from changelens.config import JobConfig
from changelens.functions import fixed
from changelens.operators import symbols as sy

SCHEMA = "repo STRING, pr_id INT, path STRING, content STRING"

GO = """package demo

// Stack keeps numbers.
type Stack struct {
\titems []float64
}

func NewStack() *Stack {
\treturn &Stack{}
}

func (s *Stack) Push(a, b float64) float64 {
\treturn a
}

func (s *Stack) Pop(
\tdepth int,
\tnames ...string,
) error {
\treturn nil
}

func (Stack) Size() int { return 0 }

type StackError struct {
\tmessage string
}

func (e *StackError) Error() string { return e.message }

func Map[T any](in []T, f Mapper) []T { return nil }

func raw(int, string) {}

type Alias = Stack
type Reader interface{}
"""


def files(spark, *pairs):
    return spark.createDataFrame([("r", 1, p, c) for p, c in pairs], SCHEMA)


def test_go_declarations(spark, rows):
    found = sy.symbols(files(spark, ("a.go", GO)))
    assert rows(sy.functions(found), "name", "line", "args") == sorted(
        [
            ("NewStack", 8, []),
            ("Push", 12, ["a", "b"]),
            ("Pop", 16, ["depth", "names"]),
            ("Size", 23, []),
            ("Error", 29, []),
            ("Map", 31, ["in", "f"]),
            ("raw", 33, []),
        ],
        key=repr,
    )
    assert rows(sy.classes(found), "name", "type", "line", "methods") == [
        ("Stack", "struct", 4, ["Push", "Pop", "Size"]),
        ("StackError", "struct", 25, ["Error"]),
    ]


NESTED = """package x
// func Commented() {}
/* type Blocked struct {
}
func Blocked() {} */
var text = `
func Raw() {}
` + "func Quoted() { \\" {" + string('{')

type (
\tInner struct {
\t\tpart struct{ deep int }
\t}
\tPair[K comparable, V any] struct{ key K }
\tFixed [5]struct{}
\tShape interface{ Area() float64 }
\tOther = struct{}
)

func F(cb func(int, string) (a, b error), n int, m map[string]func()) {}

func
(x *Inner)
Open(
\tsize int, // bytes
\tgo_on func(left, right int) (ok bool),
) (err error) {
\ttype Local struct{ q int }
\tlater := func(y int) int { return y }
\treturn nil
}

  func Indented(a,
    b int) {}

func Make[T interface{ ~int }](in []T) *Pair[string, T] { return nil }
func (p *Pair[K, V]) Key() K { return p.key }
func (Other) Done(struct{}, chan<- int) {}
"""


def test_go_headers_over_lines_groups_and_nesting(spark, rows):
    found = sy.symbols(files(spark, ("a.go", NESTED)))
    assert rows(sy.functions(found), "line", "name", "args") == sorted(
        [
            (20, "F", ["cb", "n", "m"]), (22, "Open", ["size", "go_on"]), (33, "Indented", ["a", "b"]),
            (36, "Make", ["in"]), (37, "Key", []), (38, "Done", []),
        ],
        key=repr,
    )
    assert rows(sy.classes(found), "line", "name", "methods") == sorted(
        [(11, "Inner", ["Open"]), (14, "Pair", []), (17, "Other", ["Done"]), (28, "Local", [])], key=repr
    )


def test_go_known_limits(spark, rows):
    """Type groups inside functions are not looked into; a missing bracket ends the search."""
    text = "func A() {\n\ttype (\n\t\tB struct{}\n\t)\n}\nfunc C() { (\nfunc D() {}\n"
    assert rows(sy.symbols(files(spark, ("a.go", text))), "name") == [("A",), ("C",)]


def test_equal_names_share_their_methods(spark, rows):
    text = "type A struct{}\nfunc f() { type A struct{} }\nfunc (a A) M() {}\nfunc (a *A) N() {}\n"
    assert rows(sy.classes(sy.symbols(files(spark, ("a.go", text)))), "name", "line", "methods") == [
        ("A", 1, ["M", "N"]), ("A", 2, ["M", "N"])
    ]


def test_a_file_of_very_many_declarations(spark):
    text = "".join(f"type T{i} struct{{ a int }}\nfunc (t *T{i}) M{i}(x, y int) {{}}\n" for i in range(30_000))
    begin = time.time()
    row = sy.symbols(files(spark, ("a.go", text))).selectExpr(
        "count(*) n", "max(line) last", "sum(size(methods)) methods", "sum(size(args)) args"
    ).first()
    assert tuple(row) == (60_000, 60_000, 30_000, 60_000)
    assert time.time() - begin < 60


def test_python_top_level_only(spark, rows):
    text = "def one(a):\n    pass\nasync def two():\n    pass\nclass Three(Base):\n    def four(self): pass\ndef  five ():\n"
    found = sy.symbols(files(spark, ("a.py", text)))
    assert rows(found, "kind", "name", "line") == [("class", "Three", 0), ("function", "five", 0), ("function", "one", 0)]


def test_carriage_returns_do_not_begin_lines(spark, rows):
    found = sy.symbols(files(spark, ("a.py", "x = 1\rdef hidden():\n\u2028def also():\n")))
    assert rows(found, "name") == []


def test_script_functions_and_classes(spark, rows):
    text = (
        "export function one(x) {}\nconst two = async (a, b) => a;\nlet three = function () {};\n"
        "var four = async function () {};\nconst five = x => x;\nconst six = 1;\n  class Seven {}\n"
    )
    found = sy.symbols(files(spark, ("a.js", text), ("b.ts", "function eight() {}")))
    assert rows(found, "language", "kind", "name", "ord") == sorted(
        [
            ("javascript", "function", "one", 0),
            ("javascript", "function", "two", 1),
            ("javascript", "function", "three", 2),
            ("javascript", "function", "four", 3),
            ("javascript", "class", "Seven", 4),
            ("typescript", "function", "eight", 0),
        ],
        key=repr,
    )


def test_other_and_empty_files_have_no_symbols(spark, rows):
    found = sy.symbols(
        files(spark, ("a.java", "class A {}"), ("b.rb", "def x"), ("c.go", ""), ("d.py", None), ("e", "def x():"))
    )
    assert rows(found) == []
    assert rows(sy.with_symbols(files(spark, ("c.go", "package x\n"), ("d.py", "x = 1\n")))) == []


def test_semantic_changes_are_for_go_only(spark, rows):
    found = sy.symbols(files(spark, ("a.go", "type A struct {\n}\nfunc B() {}\n"), ("b.py", "class C:\n  pass\n")))
    changes = sy.semantic_changes(found)
    assert rows(changes, "type", "name", "impact") == [
        ("function_modified", "B", "medium"),
        ("struct_modified", "A", "high"),
    ]
    assert rows(sy.high_impact(changes), "name") == [("A",)]


def test_framework_lookup_and_table_agree(spark, rows):
    found = spark.createDataFrame([(x,) for x in ("go", "python", "ruby", "unknown")], "language STRING")
    frameworks = JobConfig().frameworks
    table = spark.createDataFrame(list(frameworks.items()), "language STRING, framework STRING")
    by_map = rows(sy.with_framework(found, frameworks), "language", "framework")
    assert by_map == rows(sy.with_framework_table(found, table), "language", "framework")
    assert ("ruby", "testing") in by_map


def test_source_join_keeps_symbols_without_file(spark, rows):
    found = sy.symbols(files(spark, ("a.py", "def x():\n"))).withColumn("path", F.lit("gone.py"))
    joined = sy.with_source(found, files(spark, ("a.py", "text")))
    assert rows(joined, "name", "content") == [("x", "")]


def test_patterns_run_once_per_text(spark, tmp_path):
    """The extraction must not be pushed to the scan as a filter."""
    table = str(tmp_path / "files")
    files(spark, ("a.py", "def x():\n")).write.parquet(table)
    source = spark.read.parquet(table)
    for df in (sy.symbols(source), sy.with_symbols(source)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("(?md)^def") == 1
        assert plan.count("//[^\\n]*+") == 2  # once for what is between, once for the line ends


def test_fast_script_pattern_finds_the_same(spark):
    rng = random.Random(5)
    words = ["function ", "const ", "let ", "var ", "async ", "a", "b1", " = ", "(x) =>", "function(", "=", "\n", "(", ") =>", "xconst "]
    texts = ["".join(rng.choices(words, k=12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    both = df.select(
        F.regexp_extract_all("t", F.lit(sy._SCRIPT_FUNCTION), F.lit(0)).alias("fast"),
        F.regexp_extract_all("t", F.lit(fixed.SCRIPT_FUNCTION), F.lit(0)).alias("plain"),
    )
    assert both.where("size(plain) > 0").count() > 500
    assert both.where("fast != plain").count() == 0
