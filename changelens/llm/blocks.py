"""Groups of any size compared within themselves, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices


def in_blocks(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """The rows with grp and side in place of `key`.

    A key with at most `block` rows is one group, whose rows are of side 2: compare all.
    The rows of a larger key are dealt to blocks by a hash of `member`; each two blocks
    are a group of sides 0 and 1, and each block a group of side 2, so every two rows
    of a key meet in one group. Sizes are counted before, without the other columns.
    """
    big = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    many = big.select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    alone = F.col("blocks").isNull()
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks")).cast("int")
    others = F.when(alone, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(many, key, "left").withColumn("own_block", own).withColumn("other_block", F.explode(others))
    low, high = F.least("own_block", "other_block"), F.greatest("own_block", "other_block")
    side = F.when(alone | (F.col("own_block") == F.col("other_block")), 2)
    return dealt.select(
        F.xxhash64(key, F.coalesce(low, F.lit(-1)), F.coalesce(high, F.lit(-1))).alias("grp"),
        side.otherwise((F.col("own_block") > F.col("other_block")).cast("int")).alias("side"),
        *[c for c in rows.columns if c != key],
    )


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by `grp` as tables that hold whole groups, several small ones at a time."""
    rest: pa.Table | None = None
    for batch in slices(batches, rows):
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        groups = table.column("grp").to_numpy()
        cut = int(np.searchsorted(groups, groups[-1]))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None:
        yield rest.combine_chunks()
