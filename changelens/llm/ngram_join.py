"""Jaccard self-join on word n-grams with adaptive multi-match prefixes.

A document is the set of its distinct word n-grams, as 64-bit hashes. All sets
are read in one order of the grams: frequent grams last, hash order otherwise.
If two sets overlap enough to be similar, then for any level l their prefixes of
n - t + l grams (t: least overlap) share l grams at least. Longer prefixes cost
longer lists but need more matches, so every document picks the level with the
least estimated candidate cost, and a pair must match as often as the lower of
its two levels says before it is verified on the full sets. The rest of a set behind
its prefix bounds what else can be shared, which asks for still more matches when the
sizes are close.

How it stays linear:

* Equal sets are one class with one row (`key`); copies are never paired.
* Which grams are frequent comes from counts over all texts, added up and packed
  by task before the shuffle; the frequent ones reach the tasks as a filter of
  fixed size. A gram taken for frequent by mistake only changes the order, never
  the result.
* Prefix grams are counted in the same packed way. If for some level a prefix has
  fewer grams that may occur elsewhere than the level asks for, the document has
  no partner and goes; only the others become rows of inverted lists.
* Only components are wanted, so a pair whose ends are connected already needs
  no test. Star rounds first pair each class with one pivot of its lists. Of the lists
  that still hold several components, short ones are paired by a join, and one link per
  two components is kept.
* Long lists are never paired by a join. Classes that such lists connect form a cluster,
  which is compared block by block in tasks, on the full sets; a task gives a spanning
  forest of what it finds, so links stay linear in the classes however many pairs are
  similar.
* Texts are read three times: for the counts, for the prefixes, and for the full sets of
  the classes that may have a partner. The filters are sized by what they hold.

Defined results: words are runs of characters other than ASCII white space, with
A-Z lower-cased; a text with fewer words than n is one gram of all its words; a
null, empty or blank text has no grams and links with nothing; repeated rows are
copies; a null id takes the component of its copies (null if they have none);
an empty table gives an empty result. Columns but doc_id and text are ignored.
Two sets are taken as equal if their 64-bit keys and sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.blocks import in_blocks, whole_groups
from changelens.llm.bloom import Bloom, bloom_of
from changelens.llm.common import pinned, slices
from changelens.llm.components import components, local_roots
from changelens.llm.stats import mixed, word_hashes


@dataclass(frozen=True)
class JoinSettings:
    """width: words per gram; similarity: num / den; levels: most matches asked for;
    frequent: a gram that at least so many classes hold comes last in the order;
    verify_cost: cost of one verification in list entries; star_rounds: rounds that
    pair with pivots before all remaining pairs are formed; most_bits: largest size of a
    filter that is sent to the tasks (a fuller one lets more pass, which costs time only);
    wide: longest list that is paired by a join; longer ones are compared in blocks of at
    most `block` classes; docs_per_file: intermediate tables are kept in one file for so
    many documents."""

    width: int = 5
    num: int = 80
    den: int = 100
    levels: int = 16
    frequent: int = 32
    verify_cost: float = 40.0
    star_rounds: int = 2
    most_bits: int = 1 << 30
    wide: int = 32
    block: int = 512
    docs_per_file: int = 50_000


CONTRACT = JoinSettings(width=4, num=85, den=100)

_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return mixed((h * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    grams = h[: n - width + 1] * _FACTORS[0]
    for i in range(1, width):
        grams = grams + h[i : n - width + 1 + i] * _FACTORS[i]
    return np.unique(mixed(grams + np.uint64(width)))


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list column of longs from arrays of uint64, without going through Python numbers."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), _int64(values)).cast(pa.list_(pa.int64()))


class _Counting:
    """Counts of grams by range of their leading bits. A task adds up what it has seen
    and sends, per range, 32 bits of each gram; two grams with equal leading bits are
    counted as one, which filters can bear."""

    FLUSH = 1_000_000

    def __init__(self, docs: DataFrame) -> None:
        shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.bits = (8 * shuffles - 1).bit_length()
        self.shift = np.uint64(32 - self.bits)

    def coarse(self, grams: np.ndarray) -> np.ndarray:
        return grams >> self.shift

    def pack(self, pending: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(self.coarse(np.concatenate(pending)), return_counts=True)
        low, many = grams.astype(np.uint32), counts > 1
        cuts = np.searchsorted(grams >> np.uint64(32), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[p], cuts[p + 1])
            g, m = low[part], many[part]
            rows.append((p, g[~m].tobytes(), g[m].tobytes(), counts[part][m].astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["part", "once", "many", "counts"],
        )

    def packed(self, sets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0
        for grams in sets:
            pending.append(grams)
            size += len(grams)
            if size >= self.FLUSH:
                yield self.pack(pending)
                pending, size = [], 0
        if size:
            yield self.pack(pending)

    def merge(self, part: int, once: list[bytes], many: list[bytes], counts: list[bytes], least: int) -> pa.RecordBatch:
        grams = np.concatenate([np.frombuffer(x, np.uint32) for x in (*once, *many)])
        weights = np.ones(len(grams), np.int64)
        weights[sum(map(len, once)) // 4 :] = np.concatenate([np.frombuffer(x, np.uint32) for x in counts])
        order = np.argsort(grams, kind="stable")
        grams, weights = grams[order], weights[order]
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        often = np.add.reduceat(weights, starts) >= least
        return pa.RecordBatch.from_arrays([_int64(grams[starts][often].astype(np.uint64) + (np.uint64(part) << np.uint64(32)))], ["gram"])

    def at_least(self, packed: DataFrame, least: int) -> DataFrame:
        """gram (leading bits) of those counted `least` times or more."""

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held = None, ([], [], [])
            for batch in slices(batches):
                for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if row[0] != part and held[0]:
                        yield self.merge(part, *held, least)
                        held = ([], [], [])
                    part = row[0]
                    for store, data in zip(held, row[1:], strict=True):
                        store.append(data)
            if held[0]:
                yield self.merge(part, *held, least)

        return packed.repartition("part").sortWithinPartitions("part").mapInArrow(total, "gram long")


_PACKED = "part int, once binary, many binary, counts binary"


def _kept(rows: DataFrame, files: int) -> DataFrame:
    """The rows pinned in so many files at most."""
    return pinned(rows.coalesce(files))


def _filter(keys: DataFrame, files: int, settings: JoinSettings) -> Bloom:
    """A filter of the keys with 16 bits for each, within `most_bits`."""
    keys = _kept(keys, files)
    return bloom_of(keys, min(1 << max(16, (16 * keys.count()).bit_length()), settings.most_bits))


def frequent_grams(docs: DataFrame, counting: _Counting, settings: JoinSettings) -> DataFrame:
    """gram (leading bits) of those in `settings.frequent` texts or more. All texts count;
    texts with equal sets count once per task."""
    width = settings.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def sets() -> Iterator[np.ndarray]:
            for batch in slices(batches):
                for text in batch.column(0).to_pylist():
                    grams = gram_set(text, width)
                    key = _key(grams)
                    if len(grams) and key not in seen:
                        seen.add(key)
                        yield grams

        return counting.packed(sets())

    return counting.at_least(docs.select("text").mapInArrow(run, _PACKED), settings.frequent)


def _rows_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column of longs as arrays of uint64."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return (values[i:j] for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True))


def shared_grams(members: DataFrame, counting: _Counting) -> DataFrame:
    """gram (leading bits) of those in several prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counting.packed(x for batch in slices(batches) for x in _rows_of(batch.column(0)))

    return counting.at_least(members.where("n > 0").select("prefix").mapInArrow(run, _PACKED), 2)


def _least(n: int, settings: JoinSettings) -> int:
    return -(-n * settings.num // settings.den)


def possible_matches(members: DataFrame, shared: Bloom, counting: _Counting, settings: JoinSettings) -> DataFrame:
    """key, n, grams and levels of documents that may have a partner: prefix grams that
    others may hold, each with the first level at which the prefix includes it."""
    sent = members.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, grams, levels = [], [], []
            sizes = batch.column("n").to_pylist()
            for i, prefix in enumerate(_rows_of(batch.column("prefix"))):
                n = sizes[i]
                least = _least(n, settings)
                hit = sent.value.has(counting.coarse(prefix))
                level = np.maximum(np.arange(len(prefix)) - (n - least), 1)
                most = min(settings.levels, least)
                have = np.cumsum(np.bincount(level[hit], minlength=most + 1)[: most + 1])[1:]
                if (have >= np.arange(1, most + 1)).all():
                    rows.append(i)
                    grams.append(prefix[hit])
                    levels.append(level[hit].astype(np.uint64))
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column("key"), picked.column("n"), _lists(grams), _lists(levels)], ["key", "n", "grams", "levels"]
            )

    return (
        members.where("n > 0")
        .select("key", "n", "prefix")
        .mapInArrow(run, "key long, n long, grams array<long>, levels array<long>")
    )


def prefixes(docs: DataFrame, frequent: Bloom, counting: _Counting, settings: JoinSettings) -> DataFrame:
    """doc_id, n (set size), key and prefix: the first n - t + levels grams in the order."""
    width, levels = settings.width, settings.levels
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [gram_set(t, width) for t in batch.column("text").to_pylist()]
            late = shared.value.has(counting.coarse(np.concatenate(sets)))
            keys, kept, at = [], [], 0
            for grams in sets:
                n = len(grams)
                last = late[at : at + n]
                at += n
                kept.append(np.concatenate([grams[~last], grams[last]])[: n - _least(n, settings) + levels])
                keys.append(_key(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), _lists(kept)],
                ["doc_id", "n", "key", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, key long, prefix array<long>")


def gram_sets(docs: DataFrame, wanted: Bloom, settings: JoinSettings) -> DataFrame:
    """key and grams of the documents whose hashed id the filter may hold; other texts
    are not looked at and none is shuffled."""
    width = settings.width
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hit = sent.value.has(batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64))
            sets = [gram_set(t, width) for t in batch.column("text").filter(pa.array(hit)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), _lists(sets)], ["key", "grams"])

    return docs.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(run, "key long, grams array<long>")


def postings(classes: DataFrame, settings: JoinSettings) -> DataFrame:
    """gram, key, n, least (overlap), level, df of prefix grams that several classes have."""
    least = F.ceil(F.col("n") * settings.num / settings.den)
    listed = classes.select(
        "key", "n", least.alias("least"), F.explode(F.arrays_zip("grams", "levels")).alias("p")
    ).select("key", "n", "least", F.col("p.grams").alias("gram"), F.col("p.levels").cast("int").alias("level"))
    counts = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return listed.join(counts, "gram")


def choose_levels(lists: DataFrame, settings: JoinSettings) -> DataFrame:
    """key and own level. With C the entries met in the lists of a prefix, at most
    C / l classes can match l times: the estimated cost is C * (1 + verify_cost / l).
    A class with fewer shared grams in any prefix than its level asks for has no partner."""
    levels = range(1, settings.levels + 1)
    met = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).alias(f"met{k}") for k in levels]
    have = [F.sum((F.col("level") <= k).cast("int")).alias(f"have{k}") for k in levels]
    sums = lists.groupBy("key").agg(F.first("least").alias("least"), *met, *have)
    allowed = [(F.lit(k) == 1) | (F.lit(k) <= F.col("least")) for k in levels]
    enough = [~ok | (F.col(f"have{k}") >= k) for k, ok in zip(levels, allowed, strict=True)]
    options = F.array(
        *[
            F.when(ok, F.struct((F.col(f"met{k}") * (1 + settings.verify_cost / k)).alias("cost"), F.lit(k).alias("own")))
            for k, ok in zip(levels, allowed, strict=True)
        ]
    )
    best = F.array_min(F.filter(options, lambda o: o.isNotNull()))
    for condition in enough:
        sums = sums.where(condition)
    return sums.select("key", best["own"].alias("own"))


def _sizes_fit(a: Column, b: Column, settings: JoinSettings) -> Column:
    return F.least(a, b) * settings.den >= F.greatest(a, b) * settings.num


def _matches_needed(na: Column, nb: Column, owna: Column, ownb: Column, settings: JoinSettings) -> Column:
    """Least number of grams that similar sets share within their prefixes. The set whose
    prefix ends first in the order shares at most what it has behind it besides."""

    def behind(n: Column, own: Column) -> Column:
        return F.ceil(n * settings.num / settings.den) - own

    overlap = F.ceil((na + nb) * settings.num / (settings.num + settings.den))
    return F.greatest(F.least(owna, ownb), overlap - F.greatest(behind(na, owna), behind(nb, ownb)))


def class_sets(docs: DataFrame, members: DataFrame, classes: DataFrame, files: int, settings: JoinSettings) -> DataFrame:
    """key and full grams of the classes, from the text of one document each, pinned. A set
    may come twice, and sets of other classes may come along."""
    ids = members.join(classes.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return pinned(gram_sets(docs, _filter(ids.select(F.xxhash64("doc_id").alias("id")), files, settings), settings))


def _sets_of(sets: DataFrame, keys: DataFrame, files: int, settings: JoinSettings) -> DataFrame:
    """The sets of the keys, and few others; one look-up per set, and no shuffle of the rest."""
    sent = sets.sparkSession.sparkContext.broadcast(_filter(keys, files, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hit = sent.value.has(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit))

    return sets.mapInArrow(run, "key long, grams array<long>")


def verified(pairs: DataFrame, sets: DataFrame, files: int, settings: JoinSettings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = _kept(pairs.select("a", "b"), files)
    wanted = _sets_of(sets, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), files, settings)
    left = wanted.select(F.col("key").alias("a"), F.col("grams").alias("grams_a"))
    right = wanted.select(F.col("key").alias("b"), F.col("grams").alias("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    union = F.size("grams_a") + F.size("grams_b") - F.col("common")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", common.alias("common"), "grams_a", "grams_b")
        .where(F.col("common") * settings.den >= union * settings.num)
        .select("a", "b")
    )


def _pivot_pairs(lists: DataFrame, seed: int, settings: JoinSettings) -> DataFrame:
    """Per class the pivot it shares most grams with; a pivot is one class of a list."""
    rank = F.xxhash64(F.col("key"), F.lit(seed)) if seed else F.col("key")
    pivots = lists.groupBy("gram").agg(F.min(F.struct(rank.alias("rank"), "key", "n", "own", "component")).alias("p"))
    met = lists.join(pivots, "gram").where(
        (F.col("component") != F.col("p.component")) & _sizes_fit(F.col("n"), F.col("p.n"), settings)
    )
    need = _matches_needed(F.col("n"), F.col("p.n"), F.col("own"), F.col("p.own"), settings)
    counted = met.groupBy("key", F.col("p.key").alias("pivot")).agg(
        F.count(F.lit(1)).alias("shared"), F.first(need).alias("need")
    )
    counted = counted.where("shared >= need")
    return counted.groupBy("key").agg(F.max(F.struct("shared", "pivot")).alias("m")).select(
        F.col("key").alias("a"), F.col("m.pivot").alias("b")
    )


def _rest_links(lists: DataFrame, sets: DataFrame, files: int, settings: JoinSettings) -> DataFrame:
    """Links (a, b) between classes of different components that connect all that are
    similar. Pairs that share a long list at level 1 are compared in blocks; any others
    share only short lists at that level and come from the join."""
    sizes = lists.groupBy("gram").agg(
        F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    spread = sizes.where("low <> high").select("gram", "held")
    rows = _kept(lists.join(spread, "gram"), files)
    wide = rows.where(F.col("held") > settings.wide)
    in_wide = wide.groupBy("key").agg(F.count(F.lit(1)).alias("in_wide"))
    narrow = rows.where(F.col("held") <= settings.wide).join(in_wide, "key", "left").fillna(0, ["in_wide"])
    joined = verified(_narrow_pairs(narrow, settings), sets, files, settings)
    components_of = lists.select("key", "component").distinct()
    ends = joined.join(components_of.toDF("a", "ca"), "a").join(components_of.toDF("b", "cb"), "b")
    links = ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    return links.union(_cluster_links(wide, sets, files, settings))


def _narrow_pairs(lists: DataFrame, settings: JoinSettings) -> DataFrame:
    """Pairs of classes of different components in short lists that match often enough.
    Matches in long lists are not seen here, so as many as there may be are conceded."""

    def side(s: str) -> DataFrame:
        names = {"key": s, "n": f"n{s}", "level": f"level{s}", "own": f"own{s}", "component": f"c{s}", "in_wide": f"wide{s}"}
        return lists.select("gram", *[F.col(k).alias(v) for k, v in names.items()])

    low = F.least("owna", "ownb")
    met = side("a").join(side("b"), "gram").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    met = met.where(_sizes_fit(F.col("na"), F.col("nb"), settings))
    need = _matches_needed(*map(F.col, ("na", "nb", "owna", "ownb")), settings)
    counted = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("shared"),
        F.sum((F.greatest("levela", "levelb") <= low).cast("int")).alias("shared_low"),
        F.first(need).alias("need"),
        F.first(low).alias("low"),
        F.first(F.least("widea", "wideb")).alias("unseen"),
    )
    return counted.where("shared + unseen >= need and shared_low + unseen >= low").select("a", "b")


def _similar(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, settings: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of similar sets, one of `left` and one of `right` each. Grams that only
    one set has take no part in the product that counts what two sets share."""
    n = np.array([len(g) for g in grams])
    _, column, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = often > 1
    row = np.repeat(np.arange(len(grams)), n)[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(grams), 4096), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part[left] @ part[right].T
    whole = common.astype(np.int64)
    union = n[left][:, None] + n[right] - whole
    i, j = np.nonzero(whole * settings.den >= union * settings.num)
    return left[i], right[j]


def _cluster_links(wide: DataFrame, sets: DataFrame, files: int, settings: JoinSettings) -> DataFrame:
    """Links between components in clusters of classes that long lists connect at level 1.
    Every two classes of a cluster meet in one block; links are those of a spanning forest
    over the components of the block."""
    first = wide.where("level = 1").select("gram", "key", "component")
    leads = first.groupBy("gram").agg(F.min("key").alias("lead"))
    found = components(_kept(first.join(leads, "gram").select("key", "lead"), files)).toDF("key", "cluster")
    alone = leads.select(F.col("lead").alias("key"), F.col("lead").alias("cluster")).join(found, "key", "left_anti")
    clusters = first.select("key", "component").distinct().join(found.union(alone.distinct()), "key")
    spread = clusters.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    clusters = _kept(clusters.join(spread.where("low <> high").select("cluster"), "cluster"), files)
    whole = _sets_of(sets, clusters.select("key").distinct(), files, settings).dropDuplicates(["key"])
    dealt = in_blocks(clusters.join(whole, "key"), "cluster", "key", settings.block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 64):
            grp, side, component = (table.column(c).to_numpy() for c in ("grp", "side", "component"))
            grams = list(_rows_of(table.column("grams").combine_chunks()))
            cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                mine, names = side[i:j], component[i:j]
                left, right = np.flatnonzero(mine != 1), np.flatnonzero(mine != 0)
                if not len(left) or not len(right):
                    continue
                a, b = _similar(grams[i:j], left, right, settings)
                known, index = np.unique(names, return_inverse=True)
                root = local_roots(len(known), index[a], index[b])
                moved = np.flatnonzero(root != np.arange(len(known)))
                yield pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[root[moved]])], ["a", "b"])

    ordered = dealt.select("grp", "side", "component", "grams")
    return ordered.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def _labelled(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return lists.withColumn("component", F.col("key"))
    labels = components(links).withColumnRenamed("id", "key")
    return lists.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))


def similar_classes(docs: DataFrame, settings: JoinSettings = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, key) and links (a, b) between keys whose components are
    those of all similar pairs of different sets."""
    counting = _Counting(docs)
    files = 1 + docs.count() // settings.docs_per_file
    frequent = _filter(frequent_grams(docs, counting, settings), files, settings)
    members = pinned(prefixes(docs, frequent, counting, settings))
    shared = _filter(shared_grams(members, counting), files, settings)
    classes = _kept(possible_matches(members, shared, counting, settings).dropDuplicates(["key"]), files)
    lists = _kept(postings(classes, settings), files)
    own = choose_levels(lists, settings)
    lists = _kept(lists.join(own, "key").where("level <= own").select("gram", "key", "n", "level", "own"), files)
    sets = class_sets(docs, members, lists.select("key").distinct(), files, settings)
    links = None
    for seed in range(settings.star_rounds):
        found = verified(_pivot_pairs(_labelled(lists, links), seed, settings), sets, files, settings)
        links = _kept((found if links is None else links.union(found)).repartition(files), files)
    found = _rest_links(_kept(_labelled(lists, links), files), sets, files, settings)
    links = _kept((found if links is None else links.union(found)).repartition(files), files)
    return members.select("doc_id", "n", "key"), links


def near_duplicates(docs: DataFrame, settings: JoinSettings = CONTRACT) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with the same set),
    component_id (smallest id reachable by links, itself included)."""
    members, links = similar_classes(docs, settings)
    own = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    labels = components(links).withColumnRenamed("id", "key")
    classes = own.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "component").select("key", "class_id", "component_id")
    joined = members.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(classes, "key", "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, settings: JoinSettings | None = None) -> DataFrame:
    """One document of each component, that with the smallest id; columns as in `docs`.
    Rows that repeat an id are one document, of which one row stays; documents without
    an id stay unless a document with one has the same or a similar set."""
    found = pinned(near_duplicates(docs, settings or JoinSettings()).select("doc_id", "component_id"))
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    # The join and the choice among repeated rows share one exchange of the texts.
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    alone = found.where("doc_id is null and component_id is null").limit(1).count()
    return named.select(*docs.columns).union(docs.where("doc_id is null")) if alone else named.select(*docs.columns)
