import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quadloom.llm import pieces as P
from quadloom.llm.queries import piece_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "a ", " a", "  x   y  ", "▁", "a▁b", "▁▁ x", "\n", "\n\n a\tb\r\n", "日本語 テキスト 😀", "　a b", "\x00 \x01", "x" * 5000, "ab " * 20_000, " " * 500, "1234 567,8", "é é ﬁ", "Eauouon.\nEnpaeux leaux"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_equal_the_library(spark, library):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (1, " ")]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumns({"ids": F.lit("old"), "x": F.lit(1)})
    out = P.encode(frame, MODEL, end=True, decoded=True).collect()
    assert len(out) == len(data)
    for r in out:
        ids = library.encode(r.text or "") + [library.eos_id()]
        assert list(r.ids) == ids and r.decoded == library.decode(ids) and r.x == 1
    assert P.encode(frame.limit(0), MODEL).collect() == []


def test_decode_and_digests(spark, library):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    encoded = P.encode(frame, MODEL, decoded=True)
    back = {r.doc_id: r.decoded for r in P.decode(encoded.drop("decoded"), MODEL).collect()}
    for r in piece_digests(encoded).collect():
        ids = library.encode(TEXTS[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back[r.doc_id].encode()).hexdigest() and back[r.doc_id] == TEXTS[r.doc_id].replace("▁", " ")


def test_the_table_is_bounded_without_effect(monkeypatch, library):
    monkeypatch.setattr(P, "TABLE_WORDS", 2)
    table = P.PieceTable(MODEL)
    for t in TEXTS * 2:
        assert table.encode([t], False)[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(t))
    assert len(table.table) <= 2
