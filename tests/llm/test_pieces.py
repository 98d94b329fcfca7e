"""The agenda encoder against the library."""

import hashlib
import struct

import public_tokenizers
import pytest
from helpers import AWKWARD, documents, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyshelf.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.PieceModel(PATH)


def library(texts):
    return MODEL.library.encode(texts, add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab the<s>▁ \n\t\x00é中😀ﬁßñ</>in", max_size=80), max_size=6))
def test_same_ids_as_the_library(texts):
    assert MODEL.encode(texts) == library(texts)


def test_long_runs():
    texts = ["a" * 20_000, " " * 9000, "abc" * 5000, prose(4000), "".join(chr(0x4E00 + i) for i in range(3000))]
    assert MODEL.encode(texts) == library(texts)
    assert MODEL.encode(texts) == library(texts)  # from the cache


def test_whole_texts_as_one_run():
    model = pieces.PieceModel(PATH)
    model.split, model.check = False, False
    texts = ["two  spaces here", prose(30), ""]
    assert model.encode(texts) == library(texts)


def test_a_difference_raises():
    model = pieces.PieceModel(PATH)
    model._store(["▁the"], pieces.np.array([[1, 2]], pieces.np.int32))
    with pytest.raises(ValueError, match="library"):
        model.checked(["▁the"])


def test_digest_and_round_trip(spark):
    texts = AWKWARD + [prose(200)]
    rows = pieces.round_trip_digest(documents(spark, texts), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library([texts[r["doc_id"]] or ""])[0]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(MODEL.library.decode(ids).encode()).hexdigest()


def test_odd_rows_and_empty_tables(spark):
    df = odd_rows(spark, [prose(20), None, "x"])
    encoded = pieces.encode(df, PATH)
    assert set(encoded.columns) == set(df.columns) and encoded.schema["ids"].dataType.simpleString() == "array<int>"
    decoded = pieces.decode(encoded, PATH)
    assert sorted((r["text"] or "", r["decoded"]) for r in decoded.collect()) == sorted([(prose(20),) * 2] * 3 + [("", ""), ("x", "x")])
    assert pieces.round_trip_digest(df.limit(0), PATH).collect() == []
