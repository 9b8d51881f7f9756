"""Token ids in one wavelet matrix per shard.

A shard file holds the ids of a run of documents as bit planes, highest bit first.
Each plane is kept in the order that the planes above it give: rows with a 0 first,
rows with a 1 after, both in their old order. The file also holds, per plane, the number
of ones before each block (the rank directory), and the planes are compressed in frames of
their own with an offset table. An opened file (`ShardFile`) answers from the directory
and the few frames that a question needs, without decoding the shard:

* `access(i)`: the id at position i,
* `count(id, end)`: how often an id occurs before a position,
* `occurrence(id, k)`: where it occurs for the k-th time.

Format, little-endian: 8 bytes magic, 4 bytes length of a JSON header, header, sections.
The header names bits, tokens, documents and the compressed size of every section:
documents, starts, one directory per plane, then the frames of each plane, of `frame`
bytes before compression. Sections are Zstandard frames.

Documents are range-sorted by id, so shards and the documents in them are in
ascending order. Defined results: a null text is encoded as an empty one (the end
id alone); a null document id comes first; rows that repeat an id are separate
documents next to each other; an empty table gives an index without files.
Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.common import slices
from changelens.llm.stats import word_hashes, words_at
from changelens.llm.storage import committed, opened

MAGIC = b"WAVELET2"
_BLOCK = 4096  # bits between two entries of the rank directory
_STEP = _BLOCK // 8
_FRAME = 32 * _STEP  # bytes of a plane in one frame
_KEPT_WORDS = 1_500_000
_NO_ID = -(1 << 63)


class WaveletMatrix:
    """Rank and select over bit planes; `planes` are packed bits, first bit lowest."""

    def __init__(self, planes: list[np.ndarray], size: int) -> None:
        self.planes, self.size, self.bits = planes, size, len(planes)
        self._before: list[np.ndarray | None] = [None] * self.bits

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, rows = [], ids
        for level in range(bits - 1, -1, -1):
            ones = (rows >> rows.dtype.type(level)) & rows.dtype.type(1) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            rows = np.concatenate([rows[~ones], rows[ones]])
        return cls(planes, len(ids))

    def values(self, dtype=np.uint32) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        rows = np.zeros(self.size, dtype)
        for level, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            zeros = self.size - int(np.count_nonzero(ones))
            back = np.empty_like(rows)
            back[~ones] = rows[:zeros]
            back[ones] = rows[zeros:] | dtype(1 << level)
            rows = back
        return rows

    def directory(self, plane: int) -> np.ndarray:
        """Ones before each block of a plane, and in all of it."""
        if self._before[plane] is None:
            bits = self.planes[plane]
            counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), _STEP), dtype=np.int64) if len(bits) else []
            self._before[plane] = np.r_[0, np.cumsum(counts)].astype(np.int64)
        return self._before[plane]

    def block(self, plane: int, number: int) -> np.ndarray:
        """The packed bits of a block."""
        return self.planes[plane][number * _STEP : (number + 1) * _STEP]

    def _ones(self, plane: int, end: int) -> int:
        """Ones among the first `end` bits of a plane."""
        number, rest = divmod(end, _BLOCK)
        before = int(self.directory(plane)[number])
        if not rest:
            return before
        return before + int(np.count_nonzero(np.unpackbits(self.block(plane, number), bitorder="little")[:rest]))

    def _bit(self, plane: int, at: int) -> int:
        number, rest = divmod(at, _BLOCK)
        return int(self.block(plane, number)[rest >> 3]) >> (rest & 7) & 1

    def _down(self, plane: int, at: int, bit: int) -> int:
        ones = self._ones(plane, at)
        return self.size - self._ones(plane, self.size) + ones if bit else at - ones

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for plane in range(self.bits):
            bit = self._bit(plane, at)
            value = value << 1 | bit
            at = self._down(plane, at, bit)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for plane in range(self.bits):
            bit = value >> (self.bits - 1 - plane) & 1
            low, high = self._down(plane, low, bit), self._down(plane, high, bit)
        return low, high

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences of an id before position `end` (default: all)."""
        if value < 0 or value >> self.bits:
            return 0
        low, high = self._range(value, self.size if end is None else end)
        return high - low

    def occurrence(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, 0)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - (self.size - self._ones(plane, self.size)) * bit)
        return at

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th bit (from 0) of a value in a plane."""
        before = self.directory(plane)
        counts = before if bit else np.minimum(np.arange(len(before)) * _BLOCK, self.size) - before
        number = int(np.searchsorted(counts, k, "right")) - 1
        start = number * _BLOCK
        part = np.unpackbits(self.block(plane, number), count=min(_BLOCK, self.size - start), bitorder="little")
        return start + int(np.flatnonzero(part == bit)[k - int(counts[number])])


def write_shard(stream, documents: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int) -> None:
    """documents: ids as int64, in order; starts: where each begins, and the end of the last."""
    packer = zstandard.ZstdCompressor(level=1)
    matrix = WaveletMatrix.of(ids, bits)
    frames = [plane[at : at + _FRAME] for plane in matrix.planes for at in range(0, len(plane), _FRAME)]
    directories = [matrix.directory(plane).astype("<i8") for plane in range(bits)]
    sections = [documents.astype("<i8"), starts.astype("<i8"), *directories, *frames]
    packed = [packer.compress(section.tobytes()) for section in sections]
    header = {"bits": bits, "tokens": len(ids), "documents": len(documents), "frame": _FRAME, "sections": list(map(len, packed))}
    text = json.dumps(header).encode()
    stream.write(MAGIC + len(text).to_bytes(4, "little") + text)
    for part in packed:
        stream.write(part)


class ShardFile(WaveletMatrix):
    """An opened shard file; sections are read when a question needs them, and frames read
    last are kept."""

    KEPT = 64

    def __init__(self, stream) -> None:
        if stream.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(stream.read(4), "little")
        header = json.loads(stream.read(size))
        self.stream, self.frame, self.sections = stream, header["frame"], header["sections"]
        self.places = np.r_[0, np.cumsum(self.sections)] + 12 + size
        self.size, self.bits = header["tokens"], header["bits"]
        self.frames = -(-(-(-self.size // 8)) // self.frame)  # per plane
        self._before = [None] * self.bits
        self._kept: dict[int, bytes] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress

    def _section(self, number: int) -> bytes:
        self.stream.seek(int(self.places[number]))
        return self._unpack(self.stream.read(self.sections[number]))

    def documents(self) -> np.ndarray:
        return np.frombuffer(self._section(0), "<i8")

    def starts(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<i8")

    def directory(self, plane: int) -> np.ndarray:
        if self._before[plane] is None:
            self._before[plane] = np.frombuffer(self._section(2 + plane), "<i8")
        return self._before[plane]

    def block(self, plane: int, number: int) -> np.ndarray:
        frame, at = divmod(number * _STEP, self.frame)
        section = 2 + self.bits + plane * self.frames + frame
        if section not in self._kept:
            if len(self._kept) >= self.KEPT:
                self._kept.pop(next(iter(self._kept)))
            self._kept[section] = self._section(section)
        return np.frombuffer(self._kept[section], np.uint8)[at : at + _STEP]

    @property
    def planes(self) -> list[np.ndarray]:
        """All planes, decoded."""
        first = 2 + self.bits
        return [
            np.frombuffer(b"".join(self._section(first + p * self.frames + i) for i in range(self.frames)), np.uint8)
            for p in range(self.bits)
        ]


class _Store:
    """Ids of words by the hash of the word, in a table with open addressing whose look-ups
    and insertions work on whole arrays. At most half of the table is in use."""

    def __init__(self, dtype: type) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.ids = np.empty(1 << 16, self.dtype)
        self.used = self.words = 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self._empty(1 << 16)

    def _empty(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)  # 0: free
        self.rows = np.zeros(size, np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each word's ids; start -1 if the word is not here."""
        wanted = np.maximum(hashes, np.uint64(1))
        at = wanted & self.mask
        held = self.keys[at]
        row = np.where(held == wanted, self.rows[at], -1)
        open_ = np.flatnonzero((held != wanted) & (held != 0))
        at = at[open_]
        while len(open_):
            at = (at + np.uint64(1)) & self.mask
            held, mine = self.keys[at], wanted[open_]
            hit = held == mine
            row[open_[hit]] = self.rows[at[hit]]
            going = ~hit & (held != 0)
            open_, at = open_[going], at[going]
        known = row >= 0
        start, length = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        start[known], length[known] = self.starts[row[known]], self.lengths[row[known]]
        return start, length

    def _insert(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        wanted = np.maximum(hashes, np.uint64(1))
        at = wanted & self.mask
        while len(wanted):
            free = self.keys[at] == 0
            self.keys[at[free]] = wanted[free]  # of several for one place the last stays
            placed = self.keys[at] == wanted
            self.rows[at[placed]] = rows[placed]
            wanted, rows, at = wanted[~placed], rows[~placed], (at[~placed] + np.uint64(1)) & self.mask

    def add(self, hashes: np.ndarray, packed: list[bytes]) -> None:
        """Distinct words that are not here, with their packed ids."""
        if not packed:
            return
        new = np.frombuffer(b"".join(packed), self.dtype)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype().itemsize
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(new), self.dtype)])
        self.ids[self.used : self.used + len(new)] = new
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(new)
        self.words += len(packed)
        rows = np.arange(self.words - len(packed), self.words, dtype=np.int32)
        if 2 * self.words > len(self.keys):
            full = self.keys != 0
            held, old = self.keys[full], self.rows[full]
            self._empty(1 << (4 * self.words - 1).bit_length())
            self._insert(held, old)
        self._insert(hashes, rows)


class WordEncoder:
    """Ids of texts by a tokenizer that works on words.

    If the file says that white space is dropped before the merges and nothing is added
    around words, white-space separated words can be encoded alone; other tokenizers are
    refused. Distinct new words go to the library: those of letters lower-cased if the
    file lower-cases, without a closing stop or comma, and all in one string, whose ids
    are cut where a token ends a word. The ids of words are kept per Python worker, by a
    64-bit hash of the word.
    """

    _made: dict[str, WordEncoder] = {}
    _CHUNK = 20_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kinds = json.loads(self.tokenizer.to_str())
        splits = (kinds.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in splits):
            raise ValueError("the tokenizer must drop white space and leave words alone")
        self.folds = any(n["type"] == "Lowercase" for n in (kinds.get("normalizer") or {}).get("normalizers", []))
        suffix = kinds["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.bits = max(1, int(max(vocabulary.values())).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        self.store = _Store(self.dtype)
        self.marks = dict(zip(".,", self._library([".", ","]), strict=True))

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):  # a letter became several characters
            return self._library(words)
        data, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _stems(self, stems: set[str]) -> dict[str, bytes]:
        """Packed ids of words of letters, from the store or else the library."""
        ordered = list(stems)
        hashes = word_hashes("\n".join(ordered).encode())
        start, length = self.store.find(hashes)
        new = np.flatnonzero(start < 0)
        packed: list[bytes] = []
        for at in range(0, len(new), self._CHUNK):
            packed += self._letters([ordered[i] for i in new[at : at + self._CHUNK]])
        self.store.add(hashes[new], packed)
        found = {ordered[i]: p for i, p in zip(new.tolist(), packed, strict=True)}
        for i in np.flatnonzero(start >= 0).tolist():
            found[ordered[i]] = self.store.ids[start[i] : start[i] + length[i]].tobytes()
        return found

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add distinct new words to the store."""
        stem_of: list[str | None] = []
        for w in words:
            stem = w if w.isalpha() else w[:-1] if w[-1] in ".," and w[:-1].isalpha() else None
            if stem is not None and self.folds:
                if "\u0130" in stem:  # becomes a letter and a mark, which joins what follows
                    stem = None
                elif "\u03a3" not in stem:  # here the place in the word decides in Python
                    stem = stem.lower()
            stem_of.append(stem)
        ids = self._stems({s for s in stem_of if s is not None}) if any(stem_of) else {}
        others = iter(self._library([w for w, s in zip(words, stem_of, strict=True) if s is None]))
        marks = self.marks
        packed = [
            next(others) if s is None else ids[s] if w.isalpha() else ids[s] + marks[w[-1]]
            for w, s in zip(words, stem_of, strict=True)
        ]
        unknown = self.store.find(hashes)[0] < 0  # a word that is its own stem is there by now
        self.store.add(hashes[unknown], [p for p, u in zip(packed, unknown.tolist(), strict=True) if u])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        data = b"\n".join(parts)  # white space, so no word reaches into the next text
        hashes, begins, ends = words_at(data)
        if self.store.words > _KEPT_WORDS:
            self.store.clear()
        start, lengths = self.store.find(hashes)
        missing = np.flatnonzero(start < 0)
        if len(missing):
            distinct, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            cuts = zip(begins[first].tolist(), ends[first].tolist(), strict=True)
            self._learn(distinct, [data[i:j].decode() for i, j in cuts])
            start[missing], lengths[missing] = self.store.find(hashes[missing])
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        ids = self.store.ids[np.repeat(start - before, lengths) + np.arange(total)]
        bounds = np.r_[0, np.cumsum(lengths)]
        text_ends = np.cumsum([len(p) + 1 for p in parts])
        cuts = bounds[np.r_[0, np.searchsorted(begins, text_ends)]]
        return ids, np.diff(cuts)


INDEX = "shard long, part long, file string, documents long, tokens long, bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shard_tokens: int = 1 << 22) -> DataFrame:
    """Encode all texts and write shards of `shard_tokens` ids or more below `folder`
    (a document is never cut). Gives the index: one row per file, in order of
    (shard, part); a missing document id is stored as the smallest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        shard, part = TaskContext.get().partitionId(), 0
        documents: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            name = f"part-{shard:05d}-{part:05d}.wavelet"
            ids = np.concatenate(pieces)
            with committed(folder, name) as stream:
                write_shard(stream, np.concatenate(documents), np.r_[0, np.cumsum(np.concatenate(sizes))], ids, encoder.bits)
                size = stream.tell()
            row = [shard, part, name, sum(map(len, documents)), len(ids), size]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], INDEX.replace(",", "").split()[::2])

        for batch in slices(batches, 512):
            keys = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            ids, counts = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            documents.append(keys.copy())
            pieces.append(np.insert(ids, np.cumsum(counts), end_id))
            sizes.append(counts + 1)
            if sum(map(len, pieces)) >= shard_tokens:
                yield flush()
                documents, pieces, sizes, part = [], [], [], part + 1
        if documents:
            yield flush()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = f"{folder.rstrip('/')}/_index"
    given.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of little-endian 32-bit ids) and ids, which are null unless asked for."""
    index = spark.read.parquet(f"{folder.rstrip('/')}/_index")
    # Offsets within a shard first, then over one row per shard.
    shards = index.groupBy("shard").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.select("shard", "part", "file", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("offset"))
    files = placed.join(bases, "shard").select("file", (F.col("base") + F.col("offset")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(folder, name) as stream:
                    shard = ShardFile(stream)
                    documents, starts = shard.documents(), shard.starts()
                    ids = shard.values(np.uint16 if shard.bits <= 16 else np.uint32).astype("<u4")
                for at in range(0, len(documents), 4096):
                    some = documents[at : at + 4096]
                    cuts = starts[at : at + len(some) + 1]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    lists = pa.nulls(len(some), pa.list_(pa.int64()))
                    if with_ids:
                        values = pa.array(ids[cuts[0] : cuts[-1]].astype(np.int64))
                        lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), values)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, mask=some == _NO_ID),
                            pa.array(cuts[:-1] + first),
                            pa.array(np.diff(cuts)),
                            pa.array(crc, pa.int64()),
                            lists,
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    spread = files.repartition(max(1, index.count()), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
