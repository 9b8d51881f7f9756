"""A set of 64-bit numbers as a filter of fixed size, built in segments by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.stats import mixed

SEGMENTS = 16
_PROBES = 3


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    h = mixed(keys ^ np.uint64(0x9E3779B97F4A7C15))
    size = np.uint64(bits // SEGMENTS - 1)
    step = (h >> np.uint64(36)) | np.uint64(1)
    base = h >> np.uint64(4)
    return h & np.uint64(SEGMENTS - 1), [(base + np.uint64(i) * step) & size for i in range(_PROBES)]


class Bloom:
    """No number of the set is missed; others may be taken for members, the more the fuller it is."""

    def __init__(self, bits: int, parts: dict[int, bytes]) -> None:
        self.bits = bits
        words = bits // SEGMENTS // 8
        self.flags = np.zeros((SEGMENTS, words), np.uint8)
        for segment, data in parts.items():
            self.flags[segment] = np.frombuffer(data, np.uint8)
        self.empty = not parts

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), not self.empty)
        if self.empty or not len(keys):
            return found
        segment, places = _places(keys.view(np.uint64), self.bits)
        flat = self.flags.ravel()
        row = segment.astype(np.int64) * self.flags.shape[1]
        for place in places:
            p = place.astype(np.int64)
            found &= (flat[row + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return found


def bloom_of(keys: DataFrame, bits: int = 1 << 25) -> Bloom:
    """The filter of a column of longs. `bits` is a power of two; the driver gets
    bits / 8 bytes, whatever the number of rows."""
    (name,) = keys.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            segment, places = _places(values, bits)
            for s in np.unique(segment):
                mine = flags.setdefault(int(s), np.zeros(bits // SEGMENTS, bool))
                for place in places:
                    mine[place[segment == s].astype(np.int64)] = True
        for s, mine in flags.items():
            packed = np.packbits(mine, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed], pa.binary())], ["s", "flags"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            segment = _places(values, bits)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(segment)], ["k", "s"])

    rows = (
        keys.where(F.col(name).isNotNull())
        .mapInArrow(segments, "k long, s int")
        .repartition(SEGMENTS, "s")
        .mapInArrow(lambda batches: mark(b.select(["k"]) for b in batches), "s int, flags binary")
        .collect()
    )
    return Bloom(bits, {r["s"]: bytes(r["flags"]) for r in rows})
