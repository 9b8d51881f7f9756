"""Mixing of sources to target weights.

Words are summed per source, each source gets a target, and the ratio of the
two is its repetition rate. A document is taken floor(rate) times, and once
more if a hash of its id, read as a number in [0, 1), lies below the fraction.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; a null id is hashed as the word null; rows that repeat an id
share its decision; without any words all targets and copies are 0; an empty
table gives an empty result. Other columns are ignored (`mixture`) or passed
through unchanged (`repeat_documents`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import hash_fraction, pinned, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = "mixing"


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size: one row per source, summed before the shuffle."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Adds weight and target to one row per source.

    Targets share the total by weight, stop at `max_repeats` times the size, and
    what is above is shared again: target = min(cap, level * weight), where the
    level follows from running sums over sources ordered by cap / weight. Only
    one small row per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn(
        "level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    )
    final = F.first("level", ignorenulls=True).over(everything)
    return levels.withColumn("target", F.least("cap", final * F.col("weight"))).select(
        "source", "source_size", "weight", "target"
    )


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with the probability of the fraction."""
    whole = F.floor(rate)
    return (whole + (hash_fraction(seed, doc_id) < rate - whole).cast("long")).cast("long")


def _rates(targets: DataFrame) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    return targets.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mixture(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    The text is read once: ids, sources and sizes are pinned and joined with the
    rates. Sources are few and rows per source many, so the join has one row per
    key on one side and adaptive execution may split a large source.
    """
    sized = pinned(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = _rates(source_targets(source_sizes(sized), weights, max_repeats)).withColumnRenamed("source", "to_source")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("to_source")))
    taken = copies(F.col("rate"), F.col("doc_id"), seed)
    return joined.withColumn("copies", taken).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeat_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it; columns as in `docs`."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = _rates(source_targets(source_sizes(sized), weights, max_repeats)).select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate")
    )
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col("__mix_source")))
    times = F.array_repeat(F.lit(True), copies(F.col("__mix_rate"), docs["doc_id"], seed).cast("int"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(times).alias("__mix_copy")).drop("__mix_copy")
