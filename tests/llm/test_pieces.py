"""Marked-word encoding against the library on whole texts."""

import random

import pytest
import sentencepiece

from tests.llm.conftest import ODD
from tidewright.llm import packed, pieces
from tidewright.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b  ", "a\tb\n\nc", "▁", "▁a▁▁b", "a▁ b", "<s>x</s> <unk>", "é́ ﬁ \U0001f600\U0001f600 x", "\x00a \x00", "  ", "ab" * 5000, "�" * 3, "<0x41> <0x41>", "x" * 40 + " " * 40 + "y"]


def whole(text):
    ids = SP.encode(text or "")
    return ids, SP.decode(ids)


def test_texts_by_the_library(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "▁", "é", "ж", "\n", "\t", "\U0001f600", ".", "1"]
    made = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    for block in (1 << 20, 200):  # blocks of several documents, and of one
        got = {r.doc_id: (list(r.ids), r.decoded) for r in pieces.encode(docs, MODEL, block=block).collect()}
        assert got == {i: whole(t) for i, t in enumerate(made)}


def test_nulls_and_repeats(spark, odd):
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in pieces.encode(odd, MODEL).collect())
    assert got == sorted((str(row[0]), *whole(row[1])) for row in ODD)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.pieces[500].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="marker"):
        pieces.check_model(str(tmp_path / "m.model"))


def test_packed_round_trip():
    rng = random.Random(1)
    for values in ([], [0], [255, 256], [rng.getrandbits(rng.randint(1, 62)) for _ in range(1000)]):
        assert packed.unpack(packed.pack(values)).tolist() == values
    words = [b"", b"a", bytes(range(256)), b""]
    assert packed.unpack_bytes(packed.pack_bytes(words)) == words
    assert packed.unpack_bytes(packed.pack_bytes([])) == []
