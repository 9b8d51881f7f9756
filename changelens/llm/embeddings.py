"""Near-duplicate embeddings by collision-counting projections.

Every vector is projected on many seeded directions. Along one direction two
vectors collide if their projections differ by at most a window, centred at
either; vectors of cosine 0.95 or more collide much more often than others, so
pairs that collide in at least `need` of all directions are verified exactly.

Sorting by a single direction leaves a fixed share of all pairs in the window.
The directions are therefore dealt to tables, each sorted by the grid cells of
its directions together: vectors that share all cells of a table meet, and only
for them collisions are counted, over the directions of all tables. How many
directions a table has grows with the logarithm of the number of vectors, and
how many tables there are follows from the recall wanted at the threshold.
Window and count are set by the same calculation.

How groups are kept in bounds: equal vectors are one row with a weight; a cell
with more than `block` rows is cut into blocks by hash, which are compared two by
two, each two being work of their own; a pair counts in the first table in which
it meets only, so numbers of links add up; what leaves a group is one row per
vector with its number of links and the vector that it is connected with, never a
list of pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, not even their copies; vectors of different lengths
don't link; repeated ids are separate rows with separate counts, of one component
if they link; a null id is a row with a null component; an empty table gives an
empty result. Columns but vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.blocks import in_blocks, whole_groups
from changelens.llm.common import pinned, slices
from changelens.llm.components import components, local_roots
from changelens.llm.stats import mixed


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@dataclass(frozen=True)
class Plan:
    """tables * width directions; cell: grid step; window: of a collision; need: collisions."""

    tables: int
    width: int
    cell: float
    window: float
    need: int


def plan_for(rows: int, dim: int, cosine: float, recall: float, partners: float = 8.0) -> Plan:
    """The tables for `rows` unit vectors.

    A direction gives two vectors at distance d projections that differ by a normal
    deviate of d / sqrt(dim). `width` leaves a random vector about `partners` others per
    cell; `tables` find a pair at the threshold with probability `recall`; of such pairs
    one in 10,000 has fewer than `need` collisions.
    """
    near = math.sqrt(2 * (1 - cosine)) / math.sqrt(dim)
    far = math.sqrt(2.0) / math.sqrt(dim)
    cell = 6 * near

    def same_cell(sigma: float) -> float:
        c = cell / sigma
        return 2 * _normal(c) - 1 - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))

    width = max(2, math.ceil(math.log(max(rows / partners, 1)) / -math.log(same_cell(far))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same_cell(near) ** width))
    hit, n = 2 * _normal(2.0) - 1, tables * width
    need = math.floor(n * hit - 3.72 * math.sqrt(n * hit * (1 - hit)))
    return Plan(tables, width, cell, 2 * near, max(need, 1))


@dataclass(frozen=True)
class Finder:
    """Projections and counts for vectors of any length; the same in all tasks."""

    rows: int
    cosine: float
    recall: float
    seed: int = 20

    def plan(self, dim: int) -> Plan:
        return plan_for(self.rows, dim, self.cosine, self.recall)

    def projections(self, unit: np.ndarray) -> np.ndarray:
        plan, dim = self.plan(unit.shape[1]), unit.shape[1]
        made = np.random.default_rng(self.seed).standard_normal((plan.tables * plan.width, dim)) / math.sqrt(dim)
        return unit @ made.T

    def keys(self, projected: np.ndarray, dim: int) -> np.ndarray:
        """One 64-bit cell key per row and table."""
        plan = self.plan(dim)
        shift = np.random.default_rng(self.seed + 1).random(plan.tables * plan.width)
        cells = np.floor(projected / plan.cell + shift).astype(np.int64).view(np.uint64)
        keys = np.tile(np.arange(plan.tables, dtype=np.uint64) + np.uint64(dim << 20), (len(projected), 1))
        for j in range(plan.width):
            keys = mixed(keys * np.uint64(31) + cells[:, j * plan.tables : (j + 1) * plan.tables])
        return keys.view(np.int64)

    def links(self, groups: np.ndarray, side: np.ndarray, table: np.ndarray, unit: np.ndarray):
        """Index pairs of rows of one group (of sorted `groups`) that meet in no earlier
        table, collide often enough and are similar. Sides 0 and 1 are compared with
        each other only, side 2 with itself."""
        plan = self.plan(unit.shape[1])
        projected = self.projections(unit)
        keys = self.keys(projected, unit.shape[1])
        projected = projected.astype(np.float32)
        found = []
        starts = np.arange(len(groups))
        for ahead in range(1, len(groups)):
            starts = starts[starts < len(groups) - ahead]
            starts = starts[groups[starts] == groups[starts + ahead]]
            if not len(starts):
                break
            a, b = starts, starts + ahead
            apart = (side[a] == 2) | (side[a] != side[b])
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000][apart[at : at + 50_000]], b[at : at + 50_000][apart[at : at + 50_000]]
                old = (keys[x] == keys[y]) & (np.arange(plan.tables) < table[x][:, None])
                first = ~old.any(1)
                x, y = x[first], y[first]
                count = np.zeros(len(x), np.int32)
                for j in range(0, projected.shape[1], 32):
                    near = np.abs(projected[x, j : j + 32] - projected[y, j : j + 32]) <= plan.window
                    count += near.sum(1, dtype=np.int32)
                    alive = count + max(0, projected.shape[1] - j - 32) >= plan.need
                    x, y, count = x[alive], y[alive], count[alive]
                    if not len(x):
                        break
                good = np.einsum("ij,ij->i", unit[x], unit[y]) >= self.cosine
                found.append((x[good], y[good]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Doubles of length 1; the largest component scales first, so squares stay in range."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, values.reshape(len(at), dim)


def with_node(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and node: a hash of the vector, null if it can't link."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("embedding").isNotNull() & fine & some, F.lit(False))
    return vectors.select("vec_id", "embedding", F.when(usable, F.xxhash64(numbers)).alias("node"))


def _cells(nodes: DataFrame, finder: Finder) -> DataFrame:
    """key, tab, node, weight, embedding: one row per vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            for at, values in _by_length(batch.column("embedding")):
                unit = _unit(values)
                keys = finder.keys(finder.projections(unit), unit.shape[1])
                tables = keys.shape[1]
                rows = batch.take(pa.array(np.repeat(at, tables)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                        *(rows.column(c) for c in ("node", "weight", "embedding")),
                    ],
                    ["key", "tab", "node", "weight", "embedding"],
                )

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "weight", "embedding").mapInArrow(
        run, f"key long, tab int, node long, weight long, embedding {kind}"
    )


def linked_nodes(nodes: DataFrame, cosine: float, recall: float, block: int = 2048) -> DataFrame:
    """node, links (weight of the partners found in a group) and root (a node it is
    connected with); several rows per node."""
    finder = Finder(nodes.count(), cosine, recall)
    groups = in_blocks(_cells(nodes, finder), "key", "node", block).repartition("grp").sortWithinPartitions("grp")
    names = ["node", "links", "root"]

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: table.column(c).to_numpy() for c in ("grp", "side", "tab", "node", "weight")}
        vectors = table.column("embedding").combine_chunks()
        for at, values in _by_length(vectors):
            grp, side, tab, node, weight = (columns[c][at] for c in columns)
            a, b = finder.links(grp, side, tab, _unit(values))
            if len(a):
                links = np.bincount(a, weight[b], len(at)) + np.bincount(b, weight[a], len(at))
                root = node[local_roots(len(at), a, b)]
                rows = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array(links[rows].astype(np.int64)), pa.array(root[rows])], names
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield from compare(table)

    return groups.mapInArrow(run, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable) and kept."""
    known = pinned(with_node(vectors))
    nodes = pinned(
        known.where("node is not null")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("id"), F.first("embedding").alias("embedding"))
    )
    found = pinned(linked_nodes(nodes, cosine, recall))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select("node", "root")).withColumnRenamed("id", "node")
    placed = nodes.select("node", "weight", "id").join(links, "node", "left").join(labels, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    per_node = placed.join(least, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    joined = known.select("vec_id", "node").join(per_node, "node", "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
