from changelens.operators import reach

SCHEMA = "repo STRING, path STRING, content STRING"


def unreached(spark, rows, files, symbols):
    found = spark.createDataFrame([("r", p, c) for p, c in files], SCHEMA)
    return [t for _, t in rows(reach.unreached_tests(found, spark.createDataFrame([("r", s) for s in symbols], "repo STRING, name STRING")))]


def test_reach_through_helpers_rounds_and_methods(spark, rows):
    go = (
        "func TestA(t *testing.T) { h1(1) }\nfunc h1(n int) { h2 (n) }\nfunc (s *S) h2(n int) {\n\tif (n > 0) { load(n) }\n}\n"
        "func TestB(t *testing.T) { gone(1) }\nfunc TestC(t *testing.T) { x() }\nfunc x() { y() }\nfunc y() { x() }\n"
        "func TestNone(t *testing.T) {}\nfunc TestIf() { if (true) {} }\n"
    )
    python = "def test_d():\n    assert h1(2)\n  def test_e(self):\n    missing(3)\n"
    files = [("a", go), ("b", python), ("c", ""), ("d", None)]
    assert unreached(spark, rows, files, ["load"]) == ["TestB", "TestC", "test_e"]
    assert unreached(spark, rows, files, ["y", "missing"]) == ["TestA", "TestB", "test_d"]
    assert unreached(spark, rows, files, []) == ["TestA", "TestB", "TestC", "test_d", "test_e"]


def test_a_test_does_not_reach_its_own_name(spark, rows):
    assert unreached(spark, rows, [("a", "func TestA(t) { gone() }\n")], ["TestA"]) == ["TestA"]


def test_long_chain_and_popular_helper(spark, rows):
    chain = "".join(f"def h{i}():\n  h{i + 1}()\n" for i in range(8))
    tests = "".join(f"def test_{i}():\n  h{i % 2}()\n" for i in range(300))
    assert unreached(spark, rows, [("a", chain + tests)], ["h8"]) == []
    assert len(unreached(spark, rows, [("a", chain + tests)], ["h9"])) == 300
