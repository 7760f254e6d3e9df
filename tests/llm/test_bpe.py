import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import documents
from citeloom.llm import bpe
from hypothesis import given, settings
from hypothesis import strategies as st

VOCABULARY = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
PLAIN = tiktoken.Encoding(
    "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={}
)
ODD = st.text(alphabet="aeiou thn's.,!0129 \n\t\r\x1c\x85\xa0　éß中😀<|>%", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40)))
def test_same_as_plain_merging(text):
    packed = VOCABULARY.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert VOCABULARY.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000, "ab" * 9_000 + "\n" * 5_000, "<|endoftext|>", " x  y "])
def test_long_and_special(text):
    assert np.frombuffer(VOCABULARY.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "FITS", 3)
    small = bpe.Vocabulary(public_tokenizers.path(bpe.RANKS))
    text = "several hundred uncommonly peculiar wordforms beyond memory, twice: several hundred uncommonly peculiar"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert len(small._recent) + len(small._older) <= 3 and len(small._fits) <= 4


def test_round_trip_in_spark(spark):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (3, "tab\tand  two spaces"), (None, "ünïcödé")]
    docs = documents(spark, rows, IDS_="1")
    found = bpe.decoded(bpe.encoded(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert bpe.id_list(r.ids) == PLAIN.encode_ordinary(r.text or "")
    assert bpe.encoded(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        bpe.encoded(documents(spark, rows, Ids="1"))


def test_query(spark):
    from conftest import FOLDER

    found = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, FOLDER).collect()}
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for r in texts:
        ids = PLAIN.encode_ordinary(r.text)
        got = found[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
