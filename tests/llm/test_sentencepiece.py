import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from changelens.llm import sentencepiece as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abc  thein▁éß漢\n1.,'\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return ["", " ", "  a  b ", "Hello  world\n\tx é 漢字", "▁x▁▁y", "<s> a </s> <unk> <0x0A>", "a\u0000b", "x" * 3000, *made]


def test_ids_equal_the_library(library):
    encoder = sp.Encoder(MODEL)
    some = texts()
    for text, ids in zip(some, encoder.encode(some), strict=True):
        assert ids.tolist() == library.encode(text), text


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sp, "_KEPT_WORDS", 5)
    monkeypatch.setattr(sp, "_KEPT_PAIRS", 7)
    encoder = sp.Encoder(MODEL)
    some = texts()[:300]
    for at in range(0, 300, 9):
        for text, ids in zip(some[at : at + 9], encoder.encode(some[at : at + 9]), strict=True):
            assert ids.tolist() == library.encode(text)


def test_unigram_columns_give_the_best_sum():
    pieces = sp.Pieces(MODEL)
    pieces.merges = False
    rng = random.Random(4)
    words = sorted({" " + "".join(rng.choice("theinabs") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    trie = sp.Trie(pieces, sp._Lengths(pieces), sp._Packed(pieces))

    def best(word):
        scores = [0.0]
        for end in range(1, len(word) + 1):
            scores.append(max(
                scores[start] + pieces.scores[pieces.ids[word[start:end]]]
                for start in range(end) if word[start:end] in pieces.ids
            ))
        return scores[-1]

    for word in words:
        ids = np.frombuffer(trie.encode(word), "<i4")
        assert b"".join(pieces.texts[i] for i in ids).decode() == word
        assert sum(pieces.scores[i] for i in ids) == pytest.approx(best(word))


def test_documents_round_trip(messy, messy_rows, empty, library):
    encoded = sp.encode(messy, MODEL)
    back = sp.decode(encoded, MODEL).collect()
    want = sorted(((i, (t or "")) for i, t, _ in messy_rows), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == want
    digests = sp.encoded_digest(messy, MODEL).collect()
    assert len(digests) == len(messy_rows) and all(r["round_trip"] for r in digests)
    plain = {(r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in digests}
    ids = [(i, library.encode(t or "")) for i, t, _ in messy_rows]
    assert plain == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids}
    assert sp.encode(empty, MODEL).collect() == []


def test_mark_in_a_text_decodes_to_a_space():
    encoder = sp.Encoder(MODEL)
    assert encoder.decode(encoder.encode(["a▁b"])[0].tolist()) == "a b"


@pytest.mark.parametrize("kind", ["letters", "chinese", "digits"])
def test_long_runs_without_a_space(kind):
    rng = random.Random(4)
    alphabet = {"letters": "abcdefghijklmnopqrstuvwxyz", "chinese": "的一是不了人我在有他这为之大来以个中上们", "digits": "0123456789"}[kind]
    text = "".join(rng.choice(alphabet) for _ in range(300_000))
    path = MODEL
    encoder = sp.Encoder(path)
    encoder.encode(["warm up"])
    tracemalloc.start()
    (ids,) = encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert not any(len(word) > 64 for word in encoder.known)
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert encoder.decode(ids.tolist()) == text


def test_empty_table(empty):
    assert sp.encode(empty, MODEL).count() == 0
    assert sp.encoded_digest(empty, MODEL).count() == 0
