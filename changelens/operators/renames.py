"""Renamed and copied files between two snapshots, by the share of equal lines.

Files with equal texts are matched first, in the order of their paths. The others are
compared as bags of line hashes: the share is the number of equal lines over the lines of
the longer file. A similarity index gives the candidates:

* a line that only one side has can't help, so only shared lines become rows;
* files of one side with equal length and the same shared lines are equally similar to
  every file, so only the one with the first path can be a best partner: it stands for
  all of them, and a line that very many files share makes no list of all pairs;
* a file must share `least` lines; read with rare lines first, two such files meet in the
  first n - least + 1 lines, so only those are joined.

A renamed file and its source are each other's best partner; equal shares go by path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import text
from changelens.operators.changes import diff_snapshots
from changelens.session import pinned

FILE = ["repo", "path"]
SHARE = 50


def _texts_of(files: DataFrame, names: DataFrame) -> DataFrame:
    return files.join(names.select(*FILE), FILE, "left_semi").select(*FILE, "content")


def equal_files(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, old_path, path of files with equal texts, the k-th by path with the k-th."""
    def numbered(files: DataFrame, name: str) -> DataFrame:
        rows = files.select("repo", F.col("path").alias(name), F.sha2("content", 256).alias("digest"))
        # Ranks of equal texts: paths only, and files that occur once per snapshot.
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("repo", "digest").orderBy(name)))

    return numbered(sources, "old_path").join(numbered(targets, "path"), ["repo", "digest", "k"]).select("repo", "old_path", "path")


def _line_tokens(files: DataFrame, side: str) -> DataFrame:
    """repo, side, path, token: one row per line; equal lines of a file are numbered."""
    lines = files.select(*FILE, F.explode(text.lines(F.col("content"))).alias("line"))
    counted = lines.groupBy(*FILE, F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select(
        "repo", F.lit(side).alias("side"), "path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "line"
    ).select("repo", "side", "path", F.xxhash64("line", "k").alias("token"))


class SimilarityIndex:
    """Candidates between source files and target files (repo, path, content)."""

    def __init__(self, sources: DataFrame, targets: DataFrame, share: int = SHARE):
        tokens = pinned(_line_tokens(sources, "source").union(_line_tokens(targets, "target")))
        sizes = tokens.groupBy("repo", "side", "path").agg(F.count(F.lit(1)).alias("n"))
        both = tokens.groupBy("repo", "token").agg(
            F.count(F.lit(1)).alias("df"), F.min("side").alias("low"), F.max("side").alias("high")
        )
        shared = tokens.join(both.where("low <> high").select("repo", "token", "df"), ["repo", "token"])
        marks = [F.bit_xor(F.xxhash64("token", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
        held = shared.groupBy("repo", "side", "path").agg(F.count(F.lit(1)).alias("n_shared"), *marks)
        alike = ["repo", "side", "n", "n_shared", "mark1", "mark2"]
        least = F.ceil(F.col("n") * share / 100)
        files = held.join(sizes, ["repo", "side", "path"]).withColumn("least", least).where("n_shared >= least")
        self.share = share
        self.files = pinned(files)
        first = self.files.groupBy(*alike).agg(F.min("path").alias("path"))
        self.members = self.files.join(first.withColumnRenamed("path", "first"), alike).select("repo", "side", "path", "first")
        kept = self.files.join(first.select("repo", "side", "path"), ["repo", "side", "path"], "left_semi")
        self.tokens = pinned(shared.join(kept.select("repo", "side", "path", "n", "n_shared", "least"), ["repo", "side", "path"]))

    def pairs(self) -> DataFrame:
        """repo, source, target and share (0 to 1) of files that stand for their like."""
        file = ["repo", "side", "path"]
        rank = F.row_number().over(Window.partitionBy(*file).orderBy("df", "token"))  # lines of one file
        lead = self.tokens.withColumn("rank", rank).where(F.col("rank") <= F.col("n_shared") - F.col("least") + 1)

        def side(rows: DataFrame, name: str) -> DataFrame:
            return rows.where(F.col("side") == name).select(
                "repo", F.col("path").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "lines") if c in rows.columns],
                *[c for c in ("token",) if c in rows.columns],
            )

        longer, shorter = F.greatest("n_source", "n_target"), F.least("n_source", "n_target")
        met = side(lead, "source").join(side(lead, "target"), ["repo", "token"]).where(shorter * 100 >= longer * self.share)
        found = met.select("repo", "source", "target", longer.alias("longer")).distinct()
        whole = self.tokens.groupBy(*file).agg(F.collect_list("token").alias("lines"))  # lines of one file
        joined = found.join(side(whole, "source"), ["repo", "source"]).join(side(whole, "target"), ["repo", "target"])
        common = F.size(F.array_intersect("lines_source", "lines_target"))
        rows = joined.select("repo", "source", "target", "longer", common.alias("common"))
        return rows.where(F.col("common") * 100 >= F.col("longer") * self.share).select(
            "repo", "source", "target", (F.col("common") / F.col("longer")).alias("share")
        )


def _best(pairs: DataFrame, of: str, partner: str) -> DataFrame:
    order = F.struct((-F.col("share")).alias("falling"), F.col(partner))
    return pairs.groupBy("repo", of).agg(F.min(order).alias("b")).select("repo", of, F.col(f"b.{partner}").alias(partner))


def renamed_files(base: DataFrame, head: DataFrame, changed: DataFrame, share: int = SHARE) -> DataFrame:
    """repo, old_path, path and similarity (percent, rounded down) of files that were
    renamed. `changed`: repo, path, status of the two snapshots, pinned."""
    gone, new = changed.where("status = 'D'"), changed.where("status = 'A'")
    sources, targets = _texts_of(base, gone), _texts_of(head, new)
    equal = pinned(equal_files(sources, targets))
    rest = sources.join(equal.select("repo", F.col("old_path").alias("path")), FILE, "left_anti")
    index = SimilarityIndex(rest, targets.join(equal.select(*FILE), FILE, "left_anti"), share)
    pairs = pinned(index.pairs())
    mutual = _best(pairs, "source", "target").join(_best(pairs, "target", "source"), ["repo", "source", "target"])
    similar = pairs.join(mutual, ["repo", "source", "target"])
    return equal.select("*", F.lit(100).cast("long").alias("similarity")).union(
        similar.select("repo", F.col("source").alias("old_path"), F.col("target").alias("path"), F.floor(F.col("share") * 100).cast("long"))
    )


def copied_files(base: DataFrame, head: DataFrame, changed: DataFrame, renamed: DataFrame, share: int = SHARE) -> DataFrame:
    """repo, old_path, path, similarity of added files that resemble a file which stayed: the
    most similar one, equal shares by path; a source may be copied many times."""
    new = changed.where("status = 'A'").join(renamed.select(*FILE), FILE, "left_anti")
    targets = _texts_of(head, new)
    sources = base.join(changed.where("status = 'D'"), FILE, "left_anti").join(new.select("repo").distinct(), "repo", "left_semi")
    index = SimilarityIndex(sources, targets, share)
    pairs = pinned(index.pairs())
    best = pairs.join(_best(pairs, "target", "source"), ["repo", "target", "source"])
    likes = index.members.where("side = 'target'").select("repo", "path", F.col("first").alias("target"))
    return likes.join(best, ["repo", "target"]).select(
        "repo", F.col("source").alias("old_path"), "path", F.floor(F.col("share") * 100).cast("long").alias("similarity")
    )


def snapshot_renames(base: DataFrame, head: DataFrame, share: int = SHARE, copies: bool = False) -> DataFrame:
    """All file changes between two snapshots with renames (R) and, on request, copies (C):
    repo, path, status, old_path, similarity. A renamed file is neither added nor deleted."""
    changed = pinned(diff_snapshots(base, head))
    renamed = pinned(renamed_files(base, head, changed, share))
    moved = renamed.withColumn("status", F.lit("R"))
    taken = renamed.select(*FILE).withColumn("status", F.lit("A"))
    if copies:
        copied = pinned(copied_files(base, head, changed, renamed, share))
        moved = moved.union(copied.withColumn("status", F.lit("C")))
        taken = taken.union(copied.select(*FILE).withColumn("status", F.lit("A")))
    taken = taken.union(renamed.select("repo", F.col("old_path").alias("path")).withColumn("status", F.lit("D")))
    others = changed.join(taken, [*FILE, "status"], "left_anti")
    return moved.select(*FILE, "status", "old_path", "similarity").union(
        others.select(*FILE, "status", F.lit("").alias("old_path"), F.lit(0).cast("long").alias("similarity"))
    )
