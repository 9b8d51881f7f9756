"""The trie of conversation prefixes, with totals of all subtrees.

Every sequence of first d turns is a node of depth d. Turns are read once and become a
digest and a size; nothing behind the scan handles texts. Places of turns come from a
sort over ranges of (conversation, turn), so that a very long conversation lies in many
tasks. A prefix is identified by 128 bits: the combination (exclusive or) of two hashes
of (place, digest) over its turns, computed in blocks of turns.

A node is named by its smallest member c and its depth d. Subtree totals come from a
depth-band rollup. The path of each conversation is cut into bands of `height` depths;
within a band a node adds its numbers to its ancestors in that band, which are height
at most. What a band's root has gathered is its number in a smaller tree, of band roots
only, whose depth is less by the factor height and which is rolled up in the same way.
The completed totals of the roots then go to their ancestors in the band above. A trie
of depth D so takes log(D) to the base of height rounds down and up, and no node is
copied more than twice height times.

The digest over the ids of conversations that end in a node runs over a byte string and
is sequential by definition. Ids are sorted over ranges and written out in pieces by
many tasks; one task per node then hashes the pieces as they come, and holds one.

Defined results: turns are ordered by turn number, nulls first, equal ones by the digest
of role and text; null roles and texts are empty; repeated rows are turns of their own;
texts of any length count by their digest; rows without conv_id form no conversation; an
empty table has no nodes, not even a root. Columns but conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from changelens.llm.common import docs_of, pinned, slices

HEIGHT = 8
BLOCK = 1024
SHARED_TURNS = 9
SHARED_STEP = 5
_PIECE = 1 << 16


def _earlier(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), digest and n_bytes (of the text, in UTF-8) of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role), role, text), 256)
    rows = docs_of(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("turn").asc_nulls_first()
    dealt = pinned(
        rows.repartitionByRange(ranges, F.col("conv_id").asc(), first, F.col("digest").asc()).withColumn("part", F.spark_partition_id())
    )
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(first, "digest"))
    held = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    several = held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    before = held.join(several, "conv_id").select(
        "conv_id", "part", F.sum("n").over(_earlier("conv_id", "part")).alias("before")
    )
    # Only the first and the last conversation of a range can continue elsewhere, so this
    # table has two rows per range at most.
    placed = dealt.withColumn("here", here).join(F.broadcast(before), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "n_bytes")


def rebuilt_turns(placed: DataFrame, limit: int = SHARED_TURNS, step: int = SHARED_STEP) -> DataFrame:
    """Conversations that share first turns: c starts with the first h turns of c - c % step,
    h = crc32(c) % limit, and goes on with its own turns after its first h.

    Per conversation (conv_id) one row of depth 0, and one per turn with its depth, digest
    and n_bytes; n_turns is the number of turns. `placed` is pinned."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % limit).alias("h")
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plans = sizes.select("conv_id", "n", shared, (F.col("conv_id") - F.col("conv_id") % step).alias("base")).join(base, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plans = pinned(
        plans.select("conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    )
    top = plans.select("conv_id", "n_turns", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    columns = ["conv_id", "n_turns", F.col("depth").cast("long").alias("depth"), "digest", "n_bytes"]
    own = placed.join(plans, "conv_id").where(F.col("place") > F.col("h"))
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("taken")).select(*columns)
    firsts = placed.where((F.col("place") < limit) & (F.col("conv_id") % step == 0))
    firsts = firsts.select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "n_bytes")
    head = plans.where("taken > 0").join(firsts, "base").where(F.col("depth") <= F.col("taken")).select(*columns)
    return top.unionByName(own).unionByName(head)


def _prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, depth, n_bytes and the 128 bits (a, b) of each prefix."""
    turns = rows.where("depth > 0").withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    turns = turns.select("*", *[F.xxhash64("depth", "digest", F.lit(i)).alias(c) for i, c in enumerate("ab")])
    totals = turns.where(F.col("n_turns") > BLOCK).groupBy("conv_id", "block").agg(*[F.bit_xor(c).alias(c) for c in "ab"])
    order = _earlier("conv_id", "block")
    before = totals.select("conv_id", "block", *[F.bit_xor(c).over(order).alias(f"before_{c}") for c in "ab"])
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv_id", "block", "n_turns", "depth", "n_bytes", *[F.bit_xor(c).over(here).alias(c) for c in "ab"])
    joined = running.join(before, ["conv_id", "block"], "left")
    whole = [F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0).cast("long"))).alias(c) for c in "ab"]
    tops = rows.where("depth = 0").select("conv_id", "n_turns", "depth", "n_bytes", *[F.lit(0).cast("long").alias(c) for c in "ab"])
    return joined.select("conv_id", "n_turns", "depth", "n_bytes", *whole).union(tops)


def _members(rows: DataFrame) -> DataFrame:
    """For each conversation and depth the node it passes: conv_id, depth, node (its smallest
    member), n_convs, n_bytes, n_turns."""
    found = pinned(_prefixes(rows))
    key = ["depth", "a", "b"]
    nodes = pinned(
        found.groupBy(key).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    )
    # Hot prefixes: one row per key on the side of the nodes, so that adaptive execution can split the other.
    return pinned(found.drop("n_bytes").join(nodes, key).select("conv_id", "depth", "node", "n_convs", "n_bytes", "n_turns"))


def _added(entries: Column, name: str, start: Column) -> Column:
    return F.aggregate(entries, start, lambda total, e: total + e[name])


def _totals(path: DataFrame, deepest: int, sums: list[str], height: int) -> DataFrame:
    """Subtree sums per node: conv_id (of the node), depth and `sums`.

    `path`: conv_id, depth, node and, on the rows of a node's own conversation, `sums`."""
    own = F.col("conv_id") == F.col("node")
    entry = F.struct("depth", "node", own.alias("own"), *[F.coalesce(s, F.lit(0)).alias(s) for s in sums])
    bands = path.withColumn("band", F.floor(F.col("depth") / height)).groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")  # height rows at most
    )
    carried = [F.lit(0).cast("long").alias(f"from_{s}") for s in sums]
    if deepest >= height:
        bands = pinned(bands)
        gathered = [_added(F.col("entries"), s, F.lit(0).cast("long")).alias(s) for s in sums]
        in_band = bands.where(F.exists("entries", lambda e: e["own"])).select(F.col("entries")[0]["node"].alias("conv_id"), "band", *gathered)
        roots = in_band.groupBy("conv_id", F.col("band").alias("depth")).agg(*[F.sum(s).alias(s) for s in sums])
        above = path.where(F.col("depth") % height == 0).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "node")
        numbered = above.join(roots.withColumn("node", F.col("conv_id")), ["conv_id", "depth", "node"], "left")
        done = _totals(pinned(numbered), deepest // height, sums, height)
        below = done.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *[F.col(s).alias(f"from_{s}") for s in sums])
        bands = bands.join(below, ["conv_id", "band"], "left")
        carried = [F.coalesce(f"from_{s}", F.lit(0)).alias(f"from_{s}") for s in sums]
    bands = bands.select("entries", *carried)

    def reach(entries: Column, i: Column) -> Column:
        mine = F.slice(entries, i + 1, F.size(entries) - i)
        numbers = [_added(mine, s, F.col(f"from_{s}")).alias(s) for s in sums]
        return F.struct(entries[i]["node"].alias("conv_id"), entries[i]["depth"].alias("depth"), *numbers)

    given = F.explode(F.transform("entries", lambda _, i: reach(F.col("entries"), i))).alias("e")
    some = [F.col(f"from_{s}") != 0 for s in sums]
    useful = F.exists("entries", lambda e: e["own"])
    for condition in some:
        useful = useful | condition
    return bands.where(useful).select(given).select("e.*").groupBy("conv_id", "depth").agg(*[F.sum(s).alias(s) for s in sums])


def _end_digests(members: DataFrame) -> DataFrame:
    """conv_id and depth of the nodes in which conversations end, with the SHA-256 of their
    ids in order."""
    ranges = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = members.where("depth = n_turns").select("node", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _PIECE):
            nodes, depths, ids = (batch.column(i).to_pylist() for i in range(3))
            cuts = [i for i in range(len(ids)) if not i or (nodes[i], depths[i]) != (nodes[i - 1], depths[i - 1])]
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            first = pa.array(cuts, pa.int64())
            picked = batch.take(first)
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(texts, pa.string())], ["node", "depth", "conv_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, hashlib.sha256()
        for batch in slices(batches):
            done = []
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) == held:
                    state.update(f",{ids}".encode())
                    continue
                if held:
                    done.append((*held, state.hexdigest()))
                held, state = (node, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["conv_id", "depth", "ends_sha256"])
        if held:
            row = (*held, state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["conv_id", "depth", "ends_sha256"])

    order = ["node", "depth", "conv_id"]
    packed = ends.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(pieces, "node long, depth long, conv_id long, ids string")
    whole = packed.repartition("node", "depth").sortWithinPartitions(*order)
    return whole.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of conversations given as by `rebuilt_turns`: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    members = _members(rows)
    parents = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    own = members.where(F.col("conv_id") == F.col("node")).select("conv_id", "depth", "n_convs", "n_bytes")
    nodes = pinned(own.join(parents, ["conv_id", "depth"], "left"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    leaf = F.col("n_children").isNull().cast("long")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    nodes = pinned(
        nodes.join(children, ["conv_id", "depth"], "left").select("*", leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    )
    sums = ["n_leaves", "saved_tokens"]
    numbers = nodes.select("conv_id", "depth", F.col("conv_id").alias("node"), *sums)
    path = members.select("conv_id", "depth", "node").join(numbers, ["conv_id", "depth", "node"], "left")
    deepest = members.agg(F.max("depth")).first()[0] or 0
    totals = _totals(pinned(path), deepest, sums, height)
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.drop(*sums)
        .join(totals, ["conv_id", "depth"])
        .join(_end_digests(members), ["conv_id", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            *sums,
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def shared_prefix_trie(turns: DataFrame, limit: int = SHARED_TURNS, step: int = SHARED_STEP, height: int = HEIGHT) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt_turns(pinned(placed_turns(turns)), limit, step), height)
