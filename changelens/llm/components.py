"""Connected components of a graph given as edges, by alternating star operations.

Each round links every node to the smallest node it knows, once over its larger
and once over its smaller neighbours. Edges stay linear in number; each round is
pinned in the shared checkpoint folder, so lineage stays short and a lost
executor costs one round. A node with very many neighbours is a skewed join with
one row per key on the other side, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import pinned


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number that each of n rows is connected with by edges a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_smallest(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), "u")
    ends = F.array(F.col("u"), F.col("v"))
    return joined.select(F.explode(ends).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest reachable id) of every node that has an edge.

    `edges` has two columns of one integer type, in any order, with repeats and
    loops allowed; edges with a null end are ignored. They are read twice, so they should
    be pinned. Every round is written in few files, a million edges each.
    """
    a, b = edges.columns
    files = 1 + edges.count() // 1_000_000
    stars = pinned(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        .coalesce(files)
    )
    seen = _print(stars)
    while seen[0]:
        stars = pinned(_small_star(_large_star(stars)).coalesce(files))
        now = _print(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
