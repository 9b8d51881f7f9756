"""Numpy helpers over the words of one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small integers, equal for equal words, in order of first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**width < 1 << 62:
        key = np.zeros(n, np.int64)
        for i in range(width):
            key = key * base + ids[i : i + n]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        rows = np.stack([ids[i : i + n] for i in range(width)], 1)
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = counts[inverse.ravel()] > 1
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_RNG = np.random.default_rng(71)
_BYTE_VALUES = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_FACTORS = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\f\r")] = True
_SEGMENT = 1 << 18


class _Powers:
    """Powers of the base and of its inverse, as many as texts have needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, _BASE), np.full(size, _INVERSE)
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.cumprod(step, dtype=np.uint64) for step in steps)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _segments(text: bytes) -> Iterator[np.ndarray]:
    """The text in parts that end at white space, if it has any."""
    data, at = np.frombuffer(text, np.uint8), 0
    while len(data) - at > 2 * _SEGMENT:
        spaces = np.flatnonzero(_IS_SPACE[data[at + _SEGMENT :]][: 64 * _SEGMENT])
        cut = at + _SEGMENT + int(spaces[0]) if len(spaces) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and where it starts and ends, from running sums over the
    bytes of the text: equal words have equal hashes wherever they are."""
    found, begins, finishes, offset = [], [], [], 0
    for data in _segments(text):
        space = _IS_SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts = edge[~space[edge]]
        ends = edge[space[edge]]
        if len(data) and not space[0]:
            starts = np.r_[0, starts]
        if len(data) and not space[-1]:
            ends = np.r_[ends, len(data)]
        up, down = _powers.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up, out=sums[1:])
        found.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        begins.append(starts + offset)
        finishes.append(ends + offset)
        offset += len(data)
    return np.concatenate(found), np.concatenate(begins), np.concatenate(finishes)


def word_hashes(text: bytes) -> np.ndarray:
    return words_at(text)[0]


def covered_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more, from word hashes."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    key = hashes[:n] * _FACTORS[0]
    for i in range(1, width):
        key = key + hashes[i : i + n] * _FACTORS[i]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(width):
        covered[i : i + n] |= hit
    return int(covered.sum())
