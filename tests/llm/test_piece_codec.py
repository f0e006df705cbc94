"""The agenda of pairs against the library: awkward texts, random ids, whole tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.llm import queries
from serieslab.llm.piece_codec import PieceCodec, encode_pieces
from tests.llm.helpers import SCHEMA, clashing, rows

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["", " ", "  ", "a", " a", "a  b   c    d     e      f", "<s> </s> <unk> <0x0A>", "\n\t\r\x00x\x01", "ሴሴ é 日本語のテキスト 😀👍🏽", "▁▁x ▁ y", "   lead", "trail   ", "▁", "aaaa" * 50, "é" * 30, "́a", "�", "x y　z", "ﬁ ①"]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def test_texts(codec):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab é▁ <0x>sn日\n😀the") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in AWKWARD + made:
        ids = codec.encode(t).tolist()
        assert ids == codec.library.encode(t)
        assert codec.decode(ids) == codec.library.decode(ids)


def test_any_ids_decode_as_in_the_library(codec):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, *range(3, 300), *[rng.randrange(32000)] * 5]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == codec.library.decode(ids)


def test_long_texts_are_cut_and_few_chunks_are_remembered(codec, monkeypatch):
    from serieslab.llm import piece_codec

    monkeypatch.setattr(piece_codec, "STRETCH", 7)
    monkeypatch.setattr(piece_codec, "REMEMBERED", 5)
    monkeypatch.setattr(piece_codec, "FEW", 4)
    import pyarrow as pa

    several = ["one two three", "two  three", "four five six seven eight nine", "one", "", " x"]
    for _ in range(3):
        assert [i.tolist() for i in codec.encode_all(pa.array(several), True)] == codec.library.encode(several)
    for t in ["the quick  brown fox " * 40, "x" * 500, "a" + " " * 90 + "b", " " * 40]:
        assert codec.encode(t).tolist() == codec.library.encode(t)


def test_words_are_cut_and_merged_without_a_call_each():
    """New words of a batch take a bounded number of Python calls, and have the library's ids whatever their characters."""
    import sys

    import pyarrow as pa

    fresh, rng, calls = PieceCodec(MODEL), random.Random(3), []
    plain = " ".join({"".join(rng.choices("abcdefghijklmnoprstu.,-'0", k=rng.randint(1, 12))) for _ in range(4000)})
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" and frame.f_code.co_filename.endswith("piece_codec.py") else None)
    try:
        got = fresh.encode_all(pa.array([plain]), False)
    finally:
        sys.setprofile(None)
    assert got[0].tolist() == fresh.library.encode(plain)
    assert len(calls) < 1000
    mixed = [" ".join("".join(rng.choices("abé日ሴ😀ßn.\n\t\x00~\x7f\x80߿ࠀ￿𐀀" + "the" * 5, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    assert [i.tolist() for i in fresh.encode_all(pa.array(mixed), True)] == fresh.library.encode(mixed)
    assert [i.tolist() for i in fresh.encode_all(pa.array([], pa.string()), True)] == []


def test_texts_with_other_blanks_are_looked_up_together(monkeypatch):
    """Chunks of many texts whose blanks don't just part words are looked up at once, and long ones stretch by stretch."""
    import pyarrow as pa

    from serieslab.llm import piece_codec

    fresh, rng, calls = PieceCodec(MODEL), random.Random(5), []
    texts = ["  ".join("".join(rng.choices("abcdefgé.😀 ", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 20))) for _ in range(200)] + AWKWARD
    plain = fresh.ids_of
    monkeypatch.setattr(fresh, "ids_of", lambda chunks: calls.append(len(chunks)) or plain(chunks))
    want = fresh.library.encode(texts)
    assert [i.tolist() for i in fresh.encode_all(pa.array(texts), True)] == want
    assert len(calls) < 5
    monkeypatch.setattr(piece_codec, "STRETCH", 50)
    assert [i.tolist() for i in fresh.encode_all(pa.array(texts), True)] == want
    assert len(calls) > 50


def test_rows(spark):
    found = [*rows(3, 60), *((1000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)), (None, "x", None, None, None), (5, "again", None, None, None)]
    got = encode_pieces(clashing(spark, found).repartition(3), MODEL, whole=True).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, lib.encode(t or "")) for i, t, *_ in found]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.tokens) and r.decoded == lib.decode(r.tokens) for r in got)
    assert encode_pieces(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_a_difference_is_an_error(spark, monkeypatch):
    from serieslab.llm import piece_codec

    with pytest.raises(ValueError, match="document 7"):
        piece_codec._compare(PieceCodec(MODEL), [7], ["some text"], [PieceCodec(MODEL).encode("other text").tolist()], ["some text"])
    with pytest.raises(ValueError, match="document 7"):
        piece_codec._compare(PieceCodec(MODEL), [7], None, [PieceCodec(MODEL).encode("other text").tolist()], ["some text"])
    odd = PieceCodec(MODEL)
    odd.pairs = (odd.pairs[0], np.full(len(odd.pairs[0]), 1e30), odd.pairs[2])
    with pytest.raises(ValueError, match="'the'"):
        odd.learn(["the"], True)


def test_query(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.op13_piece_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(docs)
    for i, t in docs:
        ids = lib.encode(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
