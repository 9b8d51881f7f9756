"""Order-dependent look-back that does not depend on how rows spread over keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.session import pinned

_SLICE = "_slice"
_VALUE = "_value"
_LAST = "_is_last"
_CARRY = "_carry"


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    slices: int | None = None,
) -> DataFrame:
    """Add `out`: the last non-null `value` among the earlier rows of the same keys.

    A plain window would put all rows of a key into one task. Here the rows are
    range-partitioned by (keys, order) first, so a hot key is cut into slices
    of even size and each slice is solved by itself. What the slices of one key
    hand on is one row per slice at most; it is joined back by broadcast, and
    the number of slices bounds it. The ranges come from a sample, hence the
    sliced rows are pinned before they are used twice. `order` must be unique
    within a key for a defined result.
    """
    spark = df.sparkSession
    slices = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    in_slice = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    earlier = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    sliced = pinned(
        df.withColumn(_VALUE, value)
        .repartitionByRange(slices, *keys, *order)
        .withColumn(_SLICE, F.spark_partition_id())
        .withColumns(
            {
                out: F.last(_VALUE, ignorenulls=True).over(earlier),
                _LAST: F.lead(F.lit(True)).over(in_slice).isNull(),
            }
        )
    )

    over_slices = (
        Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    handed_on = sliced.where(_LAST).select(*keys, _SLICE, F.coalesce(_VALUE, out).alias(_CARRY))
    carried = handed_on.withColumn(
        _CARRY, F.last(_CARRY, ignorenulls=True).over(over_slices)
    ).where(F.col(_CARRY).isNotNull())
    side = {name: f"_of_{name}" for name in [*keys, _SLICE]}
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in side.items()])
    return (
        sliced.join(F.broadcast(carried.withColumnsRenamed(side)), same, "left")
        .withColumn(out, F.coalesce(out, _CARRY))
        .drop(_SLICE, _VALUE, _LAST, _CARRY, *side.values())
    )
