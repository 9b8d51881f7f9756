"""Global ranks by a distributed LSD radix sort.

The key columns are read as one long number, the first column leading, each as wide as
its range of values needs. From the lowest digit on, every pass is a stable counting
sort: rows stand in blocks of equal size; each block counts its digits; running sums
over (digit, block) say where the rows of a block with a digit begin; the place of a
row within them is its order in the block. After the pass over the leading digit the
place of a row is its rank.

No group is larger than a block, whatever the keys: a digit that all rows share is one
group per block. Counts go through one task as one row per digit only. The rows of each
pass are pinned in the shared folder, so a lost executor costs one pass at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import pinned

DIGIT_BITS = 11
BLOCK_BITS = 15
_AT, _BLOCK, _DIGIT = "__at", "__block", "__digit"


def _values(rows: DataFrame, key: Sequence[str]) -> list[tuple[Column, int]]:
    """Each key column as an unsigned number that starts at 0, and its bits."""
    ends = rows.agg(*[f(c).alias(f"{c}{i}") for c in key for i, f in enumerate((F.min, F.max))]).first()
    found = []
    for c in key:
        low, high = ends[f"{c}0"] or 0, ends[f"{c}1"] or 0
        if high - low < 1 << 63:
            found.append((F.col(c) - F.lit(low), (high - low).bit_length()))
        else:
            found.append((F.col(c).bitwiseXOR(F.lit(-(1 << 63))), 64))
    return found


def _digit(values: list[tuple[Column, int]], low: int, width: int) -> Column:
    """Bits low to low + width of the composite key; a digit may span several columns."""
    parts, at = [F.lit(0).cast("long")], 0
    for value, bits in reversed(values):
        begin, end = max(low, at), min(low + width, at + bits)
        if begin < end:
            piece = F.shiftrightunsigned(value, begin - at).bitwiseAND(F.lit((1 << (end - begin)) - 1))
            parts.append(F.shiftleft(piece, begin - low))
        at += bits
    return reduce(Column.bitwiseOR, parts).cast("int")


def _begins(placed: DataFrame) -> DataFrame:
    """Where the rows of each (block, digit) begin: behind all of smaller digits, and behind
    those of the digit in earlier blocks."""
    counts = placed.groupBy(_BLOCK, _DIGIT).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(_DIGIT).agg(F.sum("n").alias("total"))  # one row per digit
    smaller = totals.select(_DIGIT, F.sum("total").over(earlier.orderBy(_DIGIT)).alias("smaller"))
    before = F.sum("n").over(earlier.partitionBy(_DIGIT).orderBy(_BLOCK))
    return counts.withColumn("before", before).join(smaller, _DIGIT).select(
        _BLOCK, _DIGIT, (F.coalesce("before", F.lit(0)) + F.coalesce("smaller", F.lit(0))).alias("begin")
    )


def ranked(rows: DataFrame, key: Sequence[str], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with `rank`, a long: 1, 2, ... in ascending order of the key columns, which
    are longs without nulls. Rows with equal keys keep the order in which they were read."""
    columns = rows.columns
    current = pinned(rows.withColumn(_AT, F.monotonically_increasing_id()))
    values = _values(current, key)
    total = max(sum(bits for _, bits in values), 1)
    for low in range(0, total, digit_bits):
        placed = current.withColumn(_BLOCK, F.shiftright(_AT, block_bits)).withColumn(
            _DIGIT, _digit(values, low, digit_bits)
        )
        order = F.row_number().over(Window.partitionBy(_BLOCK, _DIGIT).orderBy(_AT))
        moved = placed.withColumn("__order", order).join(_begins(placed), [_BLOCK, _DIGIT])
        current = pinned(moved.select(*columns, (F.col("begin") + F.col("__order") - 1).alias(_AT)))
    return current.select(*columns, (F.col(_AT) + 1).alias("rank"))
