"""SentencePiece encoding and decoding with a shared-prefix Viterbi pass.

A text is normalised as the model file says and cut before each run of word marks,
which is exact as long as no piece has a mark behind another character. The mark
U+2581 and the space mean the same to a model; inside, both are the space, which
keeps most words in one byte a character. The distinct marked words of a batch are sorted, which
is a depth-first walk through their trie: each word starts from the forward
columns of the prefix it shares with the word before.

A forward column at position i holds the best segmentation of the first i
characters. For unigram models that is the one with the highest sum of scores.
For models trained by merges (BPE) sums of scores do not give the ids that the
model stands for; there a path may only go from piece p to piece q if merging
the text of p and q gives back p and q. A sequence is the merge result exactly
if all its neighbours are, so one path survives at each position, and the column
is its last piece.

A column is one piece (and a score), and the ids are read off once per word from its
last piece back, so memory and time are linear in the longest run without a space.

Defined results: a null text is encoded like an empty one, into no ids; repeated
rows get equal ids; ids of documents may be null; other columns are ignored; texts are
encoded whole, whatever their length; an empty table gives an empty result.
Characters without a piece become byte pieces, or the unknown id if the model
has none. Decoding gives back the text itself whenever bytes stand for unknown
characters. Short words and pairs of pieces seen last are kept per Python worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from changelens.llm.common import slices

MARK = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_KEPT_WORDS = 500_000
_KEPT_LENGTH = 64
_KEPT_PAIRS = 400_000


@dataclass
class Pieces:
    """The vocabulary of a model file and the settings that decide how to use it."""

    path: str
    ids: dict[str, int] = field(init=False)
    scores: list[float] = field(init=False)

    def __post_init__(self) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(self.path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models have pieces to choose from")
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("words must carry their mark in front")
        self.merges = model.trainer_spec.model_type == _BPE
        self.dummy_prefix = spec.add_dummy_prefix
        self.normalise: Callable[[str], str] | None = None
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            plain = sentencepiece.SentencePieceProcessor(model_file=self.path)
            plain.override_normalizer_spec(add_dummy_prefix=False, escape_whitespaces=False)
            self.normalise = plain.normalize
        self.ids, self.bytes, self.unknown, self.scores, self.texts = {}, {}, 0, [], []
        for i, piece in enumerate(model.pieces):
            text = piece.piece.replace(MARK, " ")
            self.scores.append(piece.score)
            self.texts.append(text.encode())
            if piece.type in (_NORMAL, _USER):
                self.ids[text] = i
                if " " in text.lstrip(" "):
                    raise ValueError("a piece spans two words")
            elif piece.type == _BYTE:
                byte = int(text[1:-1], 16)
                self.bytes[byte] = i
                self.texts[i] = bytes([byte])
            elif piece.type == _UNKNOWN:
                self.unknown = i
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}

    @cached_property
    def tails(self) -> dict[str, tuple[int, ...]]:
        """For each three characters the lengths of longer pieces that end with them."""
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        return {c: tuple(sorted(n, reverse=True)) for c, n in lengths.items()}

    def endings(self, tail: str) -> tuple[int, ...]:
        """Lengths of pieces that may end with the (up to three) last characters, longest
        first. One character is always a candidate."""
        longer = self.tails.get(tail, ()) if len(tail) == 3 else ()
        return (*longer, *((2,) if tail[-2:] in self.ids and len(tail) > 1 else ()), 1)

    def merged(self, text: str) -> list[str]:
        """The merge result of a short text: again and again the best pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, p: str, q: str) -> bool:
        known = self.pairs.get((p, q))
        if known is None:
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[p, q] = self.merged(p + q) == ([p, q] if p else [q])
        return known

    def packed(self, piece: str) -> bytes:
        """The ids of a piece, or of the bytes of a character without one, as 32-bit numbers."""
        found = self.ids.get(piece)
        if found is not None:
            ids = [found]
        elif self.bytes:
            ids = [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        else:
            ids = [self.unknown]
        return np.array(ids, "<i4").tobytes()

    def words_of(self, text: str) -> list[str]:
        """The marked words of a text in order, which together are the normalised text."""
        if self.normalise:
            text = self.normalise(text)
        if not text:
            return []
        text = text.replace(MARK, " ")
        if self.dummy_prefix:
            text = " " + text
        first, *rest = text.split(" ")
        words = [first] if first else []
        if "" not in rest:
            return words + [" " + part for part in rest]
        run = 0
        for part in rest:
            run += 1
            if part:
                words.append(" " * run + part)
                run = 0
        return words + [" " * run] * (run > 0)


class _Lengths(dict):
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, tail: str) -> tuple[int, ...]:
        if len(self) >= _KEPT_PAIRS:
            self.clear()
        value = self[tail] = self.pieces.endings(tail)
        return value


class _Packed(dict):
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _KEPT_PAIRS:
            self.clear()
        value = self[piece] = self.pieces.packed(piece)
        return value


class Trie:
    """Encodes sorted words one after the other, keeping the columns of the last word."""

    def __init__(self, pieces: Pieces, lengths: _Lengths, packed: _Packed) -> None:
        self.pieces, self.lengths, self.packed = pieces, lengths, packed
        self.word = ""
        self.last: list[str] = [""]  # last piece of the best segmentation up to each position
        self.total: list[float] = [0.0]  # its score (unigram)

    def encode(self, word: str) -> bytes:
        before, keep = self.word, 0
        for a, b in zip(word, before, strict=False):
            if a != b:
                break
            keep += 1
        del self.last[keep + 1 :], self.total[keep + 1 :]
        self.word = word
        if self.pieces.merges:
            self._merge_columns(word, keep)
        else:
            self._score_columns(word, keep)
        return self._walked_back()

    def _walked_back(self) -> bytes:
        """The ids of the word, from its last piece to its first."""
        last, packed, found, at = self.last, self.packed, [], len(self.word)
        while at:
            piece = last[at]
            found.append(packed[piece])
            at -= len(piece)
        found.reverse()
        return b"".join(found)

    def _merge_columns(self, word: str, keep: int) -> None:
        pieces, last, lengths = self.pieces, self.last, self.lengths
        ids, known = pieces.ids, pieces.pairs
        for end in range(keep + 1, len(word) + 1):
            for n in lengths[word[end - 3 : end] if end > 2 else word[:end]]:
                start = end - n
                if start < 0:
                    continue
                piece = word[start:end]
                if n > 1 and piece not in ids:
                    continue
                pair = (last[start], piece)
                fits = known.get(pair)
                if fits is None:
                    fits = pieces.may_follow(*pair)
                if fits:
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no segmentation of {word[:end]!r}")

    def _score_columns(self, word: str, keep: int) -> None:
        pieces = self.pieces
        for end in range(keep + 1, len(word) + 1):
            best, at = None, 0
            for n in self.lengths[word[end - 3 : end] if end > 2 else word[:end]]:
                found = pieces.ids.get(word[end - n : end]) if n <= end else None
                if found is None and n > 1:
                    continue
                score = self.total[end - n] + (pieces.scores[found] if found is not None else pieces.lowest)
                if best is None or score > best:
                    best, at = score, end - n
            self.last.append(word[at:end])
            self.total.append(best)


class Encoder:
    """Encodes batches of texts; one per Python worker and model."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.lengths, self.packed = _Lengths(self.pieces), _Packed(self.pieces)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [self.pieces.words_of(t or "") for t in texts]
        distinct = set().union(*words)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > _KEPT_WORDS:
            self.known.clear()
            new = distinct
        trie = Trie(self.pieces, self.lengths, self.packed)
        known, long = self.known, [word for word in new if len(word) > _KEPT_LENGTH]
        for word in sorted(new):
            known[word] = trie.encode(word)
        get = known.__getitem__
        rows = [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in words]
        for word in long:
            del known[word]
        return rows

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.pieces.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text[:1] == " " else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of ints). `model` is the path of a model file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in slices(batches, 1024):
            rows = encoder.encode(batch.column("text").to_pylist())
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in slices(batches):
            texts = [encoder.decode(row or []) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoded_digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids) and
    round_trip (whether decoding gives the text back), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model)
        for batch in slices(batches, 1024):
            texts = batch.column("text").to_pylist()
            rows = encoder.encode(texts)
            back = [encoder.decode(ids.tolist()) == (t or "") for ids, t in zip(rows, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                    pa.array(back, pa.bool_()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean"
    ).select(*map(F.col, ["doc_id", "n_ids", "ids_crc32", "round_trip"]))
