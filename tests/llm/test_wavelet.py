import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from changelens.llm import wavelet as wv
from changelens.session import work_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [0, 1, 9000])
def test_access_count_and_occurrence(size):
    ids = np.random.default_rng(size).integers(0, 300, size).astype(np.uint16)
    stream = io.BytesIO()
    wv.write_shard(stream, np.array([4]), np.array([0, size]), ids, 9)
    stream.seek(0)
    matrix = wv.ShardFile(stream)
    assert matrix.documents().tolist() == [4] and matrix.starts().tolist() == [0, size]
    assert matrix.values(np.uint16).tolist() == ids.tolist()
    for at in range(0, size, 41):
        assert matrix.access(at) == ids[at]
    for value in (0, 7, 299, 511, 100_000):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places)
        assert matrix.count(value, size // 3) == (ids[: size // 3] == value).sum()
        assert [matrix.occurrence(value, k) for k in range(len(places))] == places.tolist()
        with pytest.raises(IndexError):
            matrix.occurrence(value, len(places))


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_an_opened_file_reads_only_the_frames_it_needs():
    size = 2_000_000
    ids = np.random.default_rng(3).integers(0, 40_000, size).astype(np.uint16)
    plain = io.BytesIO()
    wv.write_shard(plain, np.array([1]), np.array([0, size]), ids, 16)
    value = int(ids[1_234_567])
    places = np.flatnonzero(ids == value)
    for question, answer, share in (
        (lambda m: m.access(1_234_567), value, 0.1),
        (lambda m: m.count(value, size // 2), int((ids[: size // 2] == value).sum()), 0.15),
        (lambda m: m.occurrence(value, len(places) - 1), int(places[-1]), 0.2),
    ):
        stream = Counted(plain.getvalue())
        assert question(wv.ShardFile(stream)) == answer
        assert stream.taken < share * len(plain.getvalue())


def test_store_finds_what_was_added():
    rng = np.random.default_rng(9)
    store, known = wv._Store(np.uint16), {}
    for _ in range(6):
        hashes = np.unique(np.r_[rng.integers(0, 1 << 63, 30_000, np.uint64), rng.integers(0, 300, 20, np.uint64) << np.uint64(40)])
        hashes = hashes[[int(h) not in known for h in hashes]]
        packed = [np.arange(int(h) % 5, dtype=np.uint16).tobytes() for h in hashes]
        store.add(hashes, packed)
        known.update(zip(hashes.tolist(), packed, strict=True))
    asked = np.array([*known, *range(2, 500)], np.uint64)
    start, length = store.find(asked)
    assert (start[len(known) :] < 0).all() and (start[: len(known)] >= 0).all()
    assert all(store.ids[s : s + n].tobytes() == p for s, n, p in zip(start.tolist(), length.tolist(), known.values(), strict=False))


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("aB'sdé 1.,!\n\tΣÅİ") for _ in range(40)) for _ in range(1500)]
    return [
        "", " ", "a<|endoftext|>b <|startoftext|>x", "It's they'LL 've x's", "é e ́x", "Σίγμας ΑΣ, ΑΣ.", "word, Word. WORD",
        "a\u00a0b\u3000c\u2028d\x1cx\x85y", "\u0130stanbul \u01c5 \u212b \u212a", "漢字 ok 1234 ½", "x" * 5000, *made,
    ]


@pytest.mark.parametrize("kept", [50, 10**6])
def test_ids_equal_the_library(monkeypatch, kept):
    monkeypatch.setattr(wv, "_KEPT_WORDS", kept)
    encoder, library = wv.WordEncoder(PATH), Tokenizer.from_file(PATH)
    some = texts()
    for at in range(0, len(some), 100):
        part = some[at : at + 100]
        ids, counts = encoder.encode(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, mine, e in zip(part, got, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert mine.tolist() == e.ids, text


def test_documents_round_trip(spark, messy, messy_rows, empty):
    folder = work_path(spark, "tokens-test")
    index = wv.write_tokens(messy, PATH, folder, shard_tokens=1000).collect()
    library = Tokenizer.from_file(PATH)
    ids = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in messy_rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    rows = sorted(wv.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in ids] and sum(r["documents"] for r in index) == len(rows)
    start = 0
    for r in rows:
        assert r["start"] == start and len(r["ids"]) == r["n_tokens"]
        assert (r["doc_id"], list(r["ids"])) in ids
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    wv.write_tokens(empty, PATH, folder + "-none")
    assert wv.read_tokens(spark, folder + "-none").collect() == []
