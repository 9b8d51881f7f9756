import datetime as dt

import pandas as pd
import pytest

from changelens.streaming import requests

SCHEMA = "repo STRING, pr_id LONG, event_id STRING, ts TIMESTAMP, kind STRING"
NO_PAUSE = requests.Timing(pause=dt.timedelta(0))


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Append events as a new file and take the stream to its end, as a restarted job."""

    class Stream:
        out = str(tmp_path / "out")

        def feed(self, *events, timing=NO_PAUSE, analyse=None):
            if events:
                rows = [("r", pr, e, at(t), kind) for pr, e, t, kind in events]
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = requests.start(source, self.out, str(tmp_path / "state"), timing, analyse)
            query.awaitTermination()
            return self

        def table(self, name="outcomes"):
            found = spark.read.parquet(f"{self.out}/{name}")
            return sorted((r.event_id, r.outcome) for r in found.collect())

    return Stream()


def test_newest_event_runs_repeats_and_late_ones_are_told_apart(stream):
    stream.feed((1, "a", 5, "opened"), (1, "b", 9, "synchronize"), (1, "b", 9, "synchronize"), (1, "x", 9, "closed"), (2, "c", 1, "reopened"))
    assert stream.table() == [("a", "superseded"), ("b", "repeat"), ("b", "run"), ("c", "run")]
    # A new process goes on with the state: ids are known, older events are late, newer ones run.
    stream.feed((1, "a", 5, "opened"), (1, "late", 7, "synchronize"), (1, "new", 20, "synchronize"), (3, "old", -900_000, "opened"))
    assert stream.table() == sorted(
        [("a", "repeat"), ("a", "superseded"), ("b", "repeat"), ("b", "run"), ("c", "run"), ("late", "late"), ("new", "run"), ("old", "run")]
    )
    assert stream.table("late") == [("late", "late")]


def test_a_run_waits_for_the_pause(stream):
    stream.feed((1, "a", 5, "opened"), timing=requests.Timing(pause=dt.timedelta(hours=1)))
    assert stream.table() == []
    # The event is pending: a newer one takes its place, also after a restart.
    stream.feed((1, "b", 6, "synchronize"), timing=requests.Timing(pause=dt.timedelta(0)))
    assert stream.table() == [("a", "superseded"), ("b", "run")]


def test_ids_are_forgotten_after_a_time(stream):
    short = requests.Timing(pause=dt.timedelta(0), remember=dt.timedelta(0))
    stream.feed((1, "a", 5, "opened"), timing=short)
    stream.feed((1, "a", 5, "opened"), timing=short)
    assert stream.table() == [("a", "run"), ("a", "run")]


def test_a_batch_that_fails_is_replayed_once(spark, stream):
    calls = []

    def broken(runs):
        calls.append(runs.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return runs.selectExpr("event_id", "'done' outcome")

    with pytest.raises(Exception, match="lost"):
        stream.feed((1, "a", 5, "opened"), (2, "b", 6, "opened"), analyse=broken)
    stream.feed(analyse=broken)
    assert stream.table() == [("a", "run"), ("b", "run")]
    assert stream.table("analysis") == [("a", "done"), ("b", "done")]


class Store:
    """A state handle in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, [], {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept(self))

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class Kept:
    def __init__(self, store):
        self.store, self.rows = store, {}

    def _counted(self):
        self.store.calls += 1
        return self.rows

    def exists(self):
        return bool(self._counted())

    def get(self):
        return self._counted()[()]

    def update(self, value):
        self._counted()[()] = value

    def clear(self):
        self._counted().clear()

    def containsKey(self, key):
        return key in self._counted()

    def getValue(self, key):
        return self._counted().get(key)

    def updateValue(self, key, value):
        self._counted()[key] = value

    def removeKey(self, key):
        self._counted().pop(key, None)

    def keys(self):
        for key in list(self.rows):
            self._counted()
            yield key

    def iterator(self):
        for row in list(self.rows.items()):
            self._counted()
            yield row


@pytest.fixture
def request_state():
    """A processor of one request outside Spark."""

    class State:
        def __init__(self, **timing):
            self.store = Store()
            self.processor = requests.RunRequests(requests.Timing(**timing))
            self.processor.init(self.store)

        def take(self, arrived, *chunks):
            columns = ["event_id", "ts_us", "kind"]
            frames = [pd.DataFrame([(*e, "opened") for e in chunk], columns=columns).assign(arrived_ms=arrived) for chunk in chunks]
            return self._rows(self.processor.handleInputRows(("r", 1), iter(frames), None))

        def expire(self, at):
            info = type("Expired", (), {"getExpiryTimeInMs": lambda self: at})()
            return self._rows(self.processor.handleExpiredTimer(("r", 1), None, info))

        @staticmethod
        def _rows(frames):
            return [(r.event_id, r.outcome) for frame in frames for r in frame.itertuples()]

    return State


def test_calls_to_the_state_do_not_grow_with_the_events(request_state):
    state = request_state(pause=dt.timedelta(0))
    events = [(str(n), n) for n in range(20_000)]
    found = state.take(1, events[:9_000], events[8_000:])
    assert sorted(e for e, outcome in found if outcome == "repeat") == sorted(str(n) for n in range(8_000, 9_000))
    assert sum(outcome == "superseded" for _, outcome in found) == 19_999
    assert state.expire(1) == [("19999", "run")]
    assert state.store.calls < 2_000
    # The ids are known in the next batch.
    assert state.take(2, [("77", 77), ("new", 30_000)]) == [("77", "repeat")]


def test_rounds_of_a_batch_are_one_request(request_state, monkeypatch):
    monkeypatch.setattr(requests, "ROUND", 3)
    state = request_state(pause=dt.timedelta(0))
    found = state.take(1, [("a", 1)], [("c", 3), ("b", 2)], [("c", 3)], [(None, 0)], [(None, 0), ("a", 9)])
    assert sorted(found, key=str) == sorted(
        [("a", "superseded"), ("b", "superseded"), ("c", "repeat"), (None, "superseded"), (None, "repeat"), ("a", "repeat")], key=str
    )
    assert state.expire(1) == [("c", "run")]


def test_a_timer_forgets_only_what_is_old_enough(request_state):
    state = request_state(pause=dt.timedelta(0), remember=dt.timedelta(milliseconds=10))
    state.take(1, [(str(n), n) for n in range(1_000)])
    state.take(5, [(str(n), n) for n in range(900, 2_000)])
    state.expire(5)
    assert state.take(6, [("3", 3)]) == [("3", "repeat")]
    state.expire(11)
    found = state.take(12, [("3", 5_000), ("950", 950), ("1000", 1000)])
    assert [e for e, outcome in found if outcome == "repeat"] == ["1000"]
    state.expire(22)
    assert not state.store.states["ids"].rows and not state.store.states["arrivals"].rows


def test_the_size_of_the_started_requests_is_known(stream):
    sizes = []

    def analyse(runs):
        plan = runs.select("repo", "pr_id").distinct()._jdf.queryExecution().optimizedPlan()
        sizes.append(int(str(plan.stats().sizeInBytes())))
        return runs.select("event_id", "kind")

    stream.feed(*[(1, f"e{n}", n, "opened") for n in range(5_000)], analyse=analyse)
    assert len(sizes) == 2 and max(sizes) < 5_000
