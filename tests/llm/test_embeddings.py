import math

import numpy as np
import pytest

from changelens.llm import embeddings as em


def brute(rows, cosine=0.95):
    vectors, nodes = [], []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            a = a / np.abs(a).max()
            vectors.append(a / np.linalg.norm(a))
            nodes.append(k)
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(vectors)):
        for j in range(i):
            if len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= cosine:
                links[nodes[i]] += 1
                links[nodes[j]] += 1
                root[max(find(nodes[i]), find(nodes[j]))] = min(find(nodes[i]), find(nodes[j]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (links[k], least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows)}


def table(spark, rows):
    full = [(i, v, None, "x") for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, node long, weight string")


def clustered(seed, n=500, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        x = rng.standard_normal(dim)
        for _ in range(int(rng.choice([1, 1, 1, 2, 9]))):
            y = x / np.linalg.norm(x) + rng.standard_normal(dim) * rng.choice([0.0, 0.01, 0.04]) / 2
            rows.append((len(rows) * 2 + 1, np.float32(y * rng.uniform(0.1, 9)).tolist()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed):
    rows = clustered(seed)
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in em.near_duplicate_vectors(table(spark, rows)).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in got]) >= 0.97


def test_a_large_cell_is_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16)
    rows = [(i, np.float32(x + rng.standard_normal(16) * 0.005).tolist()) for i in range(300)]
    nodes = em.with_node(table(spark, rows)).selectExpr("node", "1L weight", "vec_id id", "embedding")
    found = em.linked_nodes(nodes, 0.95, 0.99, block=32).groupBy("node").sum("links").collect()
    assert len(found) == 300 and {r[1] for r in found} == {299}


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e30, 1e29]),
        (13, [1e-38, 0.0]), (14, [0.0, 0.0]),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in em.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert em.near_duplicate_vectors(table(spark, [])).collect() == []
    again = em.near_duplicate_vectors(table(spark, [(1, [1.0]), (1, [1.0]), (None, [1.0])])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in again) == [
        ("1", 2, "1", True), ("1", 2, "1", True), ("None", 2, "None", False)
    ]


def test_plan_finds_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    dim, n = 64, 4000
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side
    finder = em.Finder(50_000, 0.95, 0.99)
    plan = finder.plan(dim)
    px, py = finder.projections(x), finder.projections(y)
    met = (finder.keys(px, dim) == finder.keys(py, dim)).any(1)
    counted = (np.abs(px - py) <= plan.window).sum(1) >= plan.need
    assert (met & counted).mean() >= 0.97
