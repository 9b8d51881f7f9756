"""Passages of benchmark items inside documents, by a prefix-filtered set join.

Every run of `width` words of an item is a window (a shorter item is one window as a
whole). A window is also a set of short shingles, runs of three words with a place. As
a window must be contained whole, its necessary prefix is one shingle: a document run
that equals it holds that shingle at the same place. So

1. the shingles of all windows are counted over all documents;
2. each window is indexed by its rarest shingle; windows with a shingle that no document
   has are done with;
3. documents are read again; their words at such shingles come out with the words around
   them, and meet the index by the shingle;
4. the place of the shingle says where the window would begin: it must lie within the
   document (length and position), and then its words are compared one by one.

Documents' words never leave their row but for the few at indexed shingles: a bit array
of bounded size, built from the shingles and part of the plan, is asked first. When it
lets a shingle through by mistake, the join drops it. Two windows with the same words are
one, so copies among the items cost nothing. The index is broadcast while it has at most
`broadcast_rows` rows and is a shuffled side of the join beyond. Hits are merged within
stretches of a document of fixed length.

DataFrame functions only. Defined results: A-Z are lower-cased, words are runs of ASCII
letters, digits and all other characters beyond ASCII; null, empty or wordless texts have
no words, no windows and no hits; texts are read whole, whatever their length; repeated
documents get equal results, items that repeat an id are one item, items without an id
mark words but are not listed; without items nothing is hit, without documents the result
is empty. Columns but doc_id, item_id and text are ignored, or passed through by
`without_contaminated`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import docs_of, let, pinned

# Upper-case letters and all ASCII characters that are in no word, and what they become.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(map(chr, [*range(0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass(frozen=True)
class Windows:
    """width: words of a window; shingle: words of a shingle; most_bits: largest size of
    the bit array, as a power of two; broadcast_rows: largest index that is broadcast;
    stretch: words of a document whose hits are merged together."""

    width: int = 10
    shingle: int = 3
    most_bits: int = 20
    broadcast_rows: int = 500_000
    stretch: int = 4096


def words_of(text: Column) -> Column:
    """The words of a text. Splitting at one character takes a tenth of the time that
    finding all matches of a pattern takes."""
    spaced = F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hash_at(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(n)], F.lit(n))


def item_windows(items: DataFrame, settings: Windows) -> DataFrame:
    """passage (words joined by a space), words and item_id, distinct."""
    held = docs_of(items, "item_id", "text").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = _upto(F.greatest(F.size("words") - settings.width + 1, F.lit(1)))
    runs = F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(settings.width)))
    found = held.select("item_id", F.explode(runs).alias("words"))
    return found.select(F.array_join("words", " ").alias("passage"), "words", "item_id").distinct()


def _shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    return F.transform(_upto(F.size(words) - n + 1), lambda i: _hash_at(words, i, n))


def window_shingles(windows: DataFrame, settings: Windows) -> DataFrame:
    """passage, n_words, shingle (hash), place and length (words) of every shingle of a window."""
    kept = ["passage", F.size("words").alias("n_words")]
    length = F.least(F.size("words"), F.lit(settings.shingle))
    parts = [
        windows.where(length == n).select(*kept, F.lit(n).alias("length"), F.posexplode(_shingles(F.col("words"), n)).alias("place", "shingle"))
        for n in range(1, settings.shingle + 1)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


class _Sieve:
    """A bit for each of a set of hashes, as a literal array of longs; the driver gets
    most_bits / 8 bytes at most."""

    def __init__(self, shingles: DataFrame, settings: Windows) -> None:
        held = shingles.groupBy("shingle", "length").count().drop("count")
        self.lengths = sorted(r["length"] for r in held.select("length").distinct().collect())
        n = held.count()
        self.bits = min(max((64 * n).bit_length(), 12), settings.most_bits)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("shingle")))
        rows = held.groupBy(self._word(F.col("shingle")).alias("word")).agg(F.bit_or(one).alias("flags")).collect()
        flags = {r["word"]: r["flags"] for r in rows}
        listed = ",".join(str(flags.get(i, 0)) for i in range(1 << (self.bits - 6)))
        self.flags = F.split(F.lit(listed), ",").cast("array<bigint>")  # folded to one literal

    def _word(self, shingle: Column) -> Column:
        return F.shiftrightunsigned(shingle, 70 - self.bits).cast("int")

    def _bit(self, shingle: Column) -> Column:
        return shingle.bitwiseAND(F.lit(63)).cast("int")

    def passes(self, shingle: Column) -> Column:
        return F.getbit(F.get(self.flags, self._word(shingle)), self._bit(shingle)) == 1

    def found(self, words: Column) -> Column:
        """at and shingle of the runs of a text that may be in the set."""

        def kept(hashes: Column) -> Column:
            places = F.filter(_upto(F.size(hashes)), lambda i: self.passes(F.get(hashes, i)))
            return F.transform(places, lambda i: F.struct(i.alias("at"), F.get(hashes, i).alias("shingle")))

        none = F.array().cast("array<struct<at:int,shingle:bigint>>")
        return F.concat(none, *[let(_shingles(words, n), kept) for n in self.lengths])


def rarest_shingles(docs: DataFrame, windows: DataFrame, settings: Windows) -> DataFrame:
    """passage, n_words, shingle, length and place: the rarest shingle of each window, by the
    number of its occurrences in all documents, of windows whose shingles all occur."""
    shingles = pinned(window_shingles(windows, settings))
    sieve = _Sieve(shingles, settings)
    met = docs.select(F.explode(let(words_of(F.col("text")), sieve.found)["shingle"]).alias("shingle"))
    counts = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(counts, "shingle", "left").groupBy("passage").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.min_by(F.struct("n_words", "shingle", "length", "place"), F.struct("n", "place")).alias("r"),
    )
    return ranked.where("least > 0").select("passage", "r.*")


def occurrences(docs: DataFrame, items: DataFrame, settings: Windows | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (row, doc_id, n_words, text_key where something may be hit),
    hits (row, start, n, passage) and items (passage, item_id)."""
    settings = settings or Windows()
    docs = docs_of(docs, "doc_id", "text")
    held = pinned(item_windows(items, settings))
    index = pinned(rarest_shingles(docs, held.select("passage", "words").distinct(), settings))
    sieve, reach = _Sieve(index, settings), settings.width - 1

    def read(words: Column) -> Column:
        def with_words(mark: Column) -> Column:
            begin = F.greatest(mark["at"] - reach, F.lit(0))
            around = F.slice(words, begin + 1, mark["at"] - begin + settings.width)
            return F.struct(mark["at"].alias("at"), mark["shingle"].alias("shingle"), begin.alias("begin"), around.alias("around"))

        return F.struct(F.size(words).cast("long").alias("n_words"), F.transform(sieve.found(words), with_words).alias("marks"))

    text = F.when(F.size("r.marks") > 0, F.sha2("text", 256)).alias("text_key")
    rows = docs.select("doc_id", "text", let(words_of(F.col("text")), read).alias("r"))
    rows = pinned(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", text, "r.*"))
    marks = rows.where("text_key is not null").select("row", F.col("n_words").alias("n_all"), F.explode("marks").alias("m"))
    size = index.count()
    known = index.select("passage", F.col("n_words").alias("n"), "shingle", "place")
    known = F.broadcast(known) if size <= settings.broadcast_rows else known
    start = F.col("m.at") - F.col("place")
    met = marks.join(known, marks["m.shingle"] == known["shingle"]).select("row", "n_all", "m", start.alias("start"), "n", "passage")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_all"))
    same = F.array_join(F.slice("m.around", F.col("start") - F.col("m.begin") + 1, F.col("n")), " ") == F.col("passage")
    hits = met.where(fits).where(same).select("row", "start", "n", "passage")
    return rows.drop("marks"), pinned(hits), held.select("passage", "item_id")


def _hit_words(hits: DataFrame, settings: Windows) -> DataFrame:
    """row and n_hit: words in the union of all hits, added up over stretches."""
    size = settings.stretch
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n"))  # the longest at each place
    ends = F.col("start") + F.col("n")
    cut = F.sequence(F.floor(F.col("start") / size), F.floor((ends - 1) / size))
    pieces = spans.withColumn("end", ends).select("row", "start", "end", F.explode(cut).alias("stretch"))
    begin, finish = F.greatest("start", F.col("stretch") * size), F.least("end", (F.col("stretch") + 1) * size)
    pieces = pieces.select("row", "stretch", begin.alias("begin"), finish.alias("end"))
    earlier = Window.partitionBy("row", "stretch").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier), F.lit(0))
    new = F.greatest(F.col("end") - F.greatest("begin", reached), F.lit(0))
    return pieces.withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, settings: Windows | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit (words inside a window that occurs), n_items
    (items with such windows), items_sha256 (of their ids, sorted as text, comma-joined) and
    contaminated."""
    settings = settings or Windows()
    rows, hits, held = occurrences(docs, items, settings)
    named = hits.select("row", "passage").distinct().join(held, "passage").where("item_id is not null")
    ids = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    listed = named.select("row", "item_id").distinct().groupBy("row").agg(ids.alias("ids"))  # as many as items
    found = _hit_words(hits, settings).join(listed, "row", "left")
    none = F.array().cast("array<string>")
    columns = [
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    marked = rows.where("text_key is not null").join(found, "row", "left").select(*columns)
    clean = rows.where("text_key is null").withColumn("n_hit", F.lit(0)).withColumn("ids", none).select(*columns)
    return marked.unionByName(clean)


def without_contaminated(docs: DataFrame, items: DataFrame, settings: Windows | None = None) -> DataFrame:
    """The rows of `docs` in whose text no window of an item occurs."""
    rows, hits, _ = occurrences(docs, items, settings)
    keys = rows.join(hits.select("row").distinct(), "row", "left_semi").select(F.col("text_key").alias("__hit")).distinct()
    return docs.join(keys, F.sha2(docs["text"], 256) == F.col("__hit"), "left_anti")
