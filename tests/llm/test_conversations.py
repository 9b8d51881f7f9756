import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from check_oracle import difference, duck
from conftest import SF

from changelens.llm import conversations, oracle, queries
from changelens.llm.conversations import placed_turns, prefix_trie, rebuilt_turns, shared_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, limit=9, step=5):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % limit
        base = c - (abs(c) % step) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        mine = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = mine + sum(saved[k] for k in children[path])
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(rebuilt[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((ids[0], len(path), parent, len(ids), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    return sorted((tuple(r) for r in shared_prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_query_equals_sql(spark):
    frame = queries.op13_conversation_trie(spark, SF).toPandas()
    assert difference(frame, duck(SF).sql(oracle.OP13_CONVERSATION_TRIE).df()) == ""


def random_rows(seed, convs, longest, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * convs), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "bot", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 8])
def test_equals_plain_reading_on_random_conversations(spark, height):
    rows = random_rows(3, 60, 12, ["a", "", None, "éx", "same"])
    assert got(spark, rows, height=height) == brute(rows)


def test_deep_conversations_with_bands_of_bands(spark, monkeypatch):
    """Long common stems that part late, so that totals cross several levels of bands."""
    monkeypatch.setattr(conversations, "BLOCK", 7)
    stem = [("user", f"t{i}") for i in range(70)]
    rows = []
    for c in range(0, 24):
        own = stem[: 5 * c // 2] + [("bot", f"own {c % 9} {i}") for i in range(c % 4)]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(own)] or [(c, None, None, None)]
    assert got(spark, rows, height=2) == brute(rows)
    assert got(spark, rows, height=3, limit=40, step=24) == brute(rows, 40, 24)


def test_hot_conversations_copies_and_turnless(spark):
    rows = [(c, t, "user", f"q{t}") for c in range(0, 500, 5) for t in range(3)]
    rows += [(c, 0, "user", "only one") for c in range(1, 500, 5)]
    rows += [(c, 0, "user", "no base") for c in range(1002, 1100, 5)]
    rows += [(7, None, "user", "x" * 100_000)] * 4 + [(None, 1, "user", "lost")] * 3
    expected = brute(rows)
    assert got(spark, rows) == expected
    turnless = [r for r in expected if r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest()]
    assert turnless  # a conversation shorter than what it would share, without a base


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", f"{t % 3}") for t in range(3000)] + [(2, 0, "bot", "b")]
    placed = placed_turns(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["place"] for r in placed.where("conv_id = 1").collect()) == list(range(1, 3001))
    nodes = prefix_trie(rebuilt_turns(placed.cache())).where("depth = 0").collect()
    assert len(nodes) == 1 and nodes[0]["n_convs"] == 2


def test_pieces_of_a_digest(spark, monkeypatch):
    monkeypatch.setattr(conversations, "_PIECE", 3)
    rows = [(c, 0, "user", "q") for c in range(0, 400, 5)]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", node long, depth string")
    assert shared_prefix_trie(empty).count() == 0
    rows = [(1, 0, "user", "a", 5, "x"), (1, 1, "bot", "b", 5, "x")]
    out = shared_prefix_trie(spark.createDataFrame(rows, SCHEMA + ", node long, depth string"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute([r[:4] for r in rows])
