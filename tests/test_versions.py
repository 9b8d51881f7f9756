import datetime as dt

import pytest

from changelens.sources.versions import VersionedTable

SCHEMA = "repo STRING, path STRING, content STRING"


@pytest.fixture
def suite(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "suite"), ["repo", "path"], buckets=4)


def files(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], SCHEMA)


def test_upsert_and_read_as_of_a_version(spark, rows, suite):
    with pytest.raises(ValueError, match="no version"):
        suite.read()
    assert suite.upsert(files(spark, ("a", "1"), ("b", "1"), ("c", "1")), "first") == 1
    assert suite.upsert(files(spark, ("b", "2"), ("d", "2")), "second") == 2
    assert rows(suite.read(), "path", "content") == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]
    assert rows(suite.read(1), "path", "content") == [("a", "1"), ("b", "1"), ("c", "1")]
    assert suite.upsert(files(spark), "nothing") == 3 and suite.read().count() == 4


def test_a_repeated_run_changes_nothing(spark, rows, suite):
    suite.upsert(files(spark, ("a", "1")), "first")
    suite.upsert(files(spark, ("a", "2")), "second")
    assert suite.upsert(files(spark, ("a", "1")), "first") == 1
    assert suite.versions() == [1, 2] and rows(suite.read(), "content") == [("2",)]


def test_a_killed_writer_leaves_nothing_and_can_be_repeated(spark, rows, suite, monkeypatch):
    suite.upsert(files(spark, ("a", "1")), "first")

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            suite.upsert(files(spark, ("a", "lost"), ("b", "lost")), "second")
    assert rows(suite.read(), "path", "content") == [("a", "1")]
    suite.upsert(files(spark, ("c", "3")), "third")
    suite.upsert(files(spark, ("a", "2"), ("b", "2")), "second")
    assert rows(suite.read(), "path", "content") == [("a", "2"), ("b", "2"), ("c", "3")]


def test_two_writers_at_a_time_lose_nothing(spark, rows, suite, monkeypatch):
    suite.upsert(files(spark, ("a", "0")), "first")
    publish, others = VersionedTable._publish, [("x", "other 1"), ("a", "other 2")]

    def interrupted(self, manifest):
        if others:  # another job publishes the number that this one is about to use
            row = others.pop()
            held, others[:] = list(others), []
            self.upsert(files(spark, row), f"other {row[0]}")
            others.extend(held)
        publish(self, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", interrupted)
    assert suite.upsert(files(spark, ("b", "mine")), "mine") == 4
    assert rows(suite.read(), "path", "content") == [("a", "other 2"), ("b", "mine"), ("x", "other 1")]


def test_newest_baseline_wins_whatever_comes_last(spark, rows, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "baselines"), ["repo"], ["ts", "run_id"])
    schema = "repo STRING, ts TIMESTAMP, run_id LONG, coverage DOUBLE"
    late, early = dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 1)
    table.upsert(spark.createDataFrame([("r", late, 7, 50.0), ("r", late, 9, 60.0)], schema), "one")
    table.upsert(spark.createDataFrame([("r", early, 99, 10.0), ("s", early, 1, 1.0)], schema), "two")
    table.upsert(spark.createDataFrame([("r", late, 8, 20.0)], schema), "three")
    assert rows(table.read(), "repo", "coverage") == [("r", 60.0), ("s", 1.0)]
    table.upsert(spark.createDataFrame([("r", late, 9, 61.0)], schema), "four")
    assert rows(table.read(), "repo", "coverage") == [("r", 61.0), ("s", 1.0)]
