import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from setforge.llm import token_file as T
from setforge.llm import tokens as K

TOK = Tokenizer.from_file(K.vocabulary("byte_bpe_50k.json"))
TEXTS = ["", "  a  b\n\n c", " 's it's  'S", "<|endoftext|> x <|endoftext|>", "日本語 text", "a  b\u0085c  ", " \t\n x²³ ½", "éÉß ſ ŉ", "naïve—dash", "\x1c\x1d x\x00y", "a  ", "x" * 70_000, "ab cd " * 30_000, "͸ x"]


def ids(text):
    return TOK.encode(text, add_special_tokens=False).ids


def test_counts():
    count = K.counter(K.CountParams())
    assert K.count_batch(TEXTS, K.CountParams(batch_bytes=100), count) == [len(ids(t)) for t in TEXTS]
    assert "".join(K.parts(TEXTS[-2], 1000)) == TEXTS[-2] and len(K.parts(TEXTS[-2], 1000)) > 100


def test_only_plain_tokenizers_cut():
    text = "several words of a long text " * 4000
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        p = K.CountParams(tokenizer=name, split_chars=1000, batch_bytes=5000)
        want = len(K.load(name).encode(text, add_special_tokens=False).ids)
        assert K.count_batch([text, "é" * 3000, text], p, K.counter(p))[::2] == [want, want]
        assert len(T.Encoder(T.FileParams(tokenizer=name)).whole(text)) == 4 * want
    assert K.cuts("byte_bpe_50k.json") and not K.cuts("word_bpe_49k.json") and not K.cuts("piece_bpe_32k.model")


def test_sentence_pieces():
    p = K.CountParams(tokenizer="piece_bpe_32k.model")
    assert K.count_batch(["a b c", ""], p, K.counter(p))[0] == len(K.load(p.tokenizer).encode("a b c"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=60))
def test_encoder_is_the_library(text):
    assert ENC(text) == np.array(ids(text), "<u4").tobytes()


ENC = T.Encoder(T.FileParams(memo=50))


def test_encoder_odd_texts():
    for t in TEXTS:
        assert ENC(t) == np.array(ids(t), "<u4").tobytes()
    words = T.Encoder(T.FileParams(tokenizer="word_bpe_49k.json"))
    assert not words.plain and len(words("a quick test")) == 4 * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(1, 32), st.integers(0, 100))
def test_blocks_round_trip(values, bits, percentile):
    a = (np.array(values, np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    if len(a) > 3:
        a[3] = 2**32 - 1
    assert (T.unpack(T.pack(a, percentile)) == a).all()


def test_file(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.op10_token_file(spark, sf).collect()}
    start = 0
    for r in docs:
        own = np.array([*ids(r.text), 0], "<u4")
        assert got[r.doc_id] == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    count = {r.doc_id: r.n_tokens for r in K.op7_token_counts(spark, sf).collect()}
    assert count == {i: n - 1 for i, (_, n, _) in got.items()}


def test_small_segments(spark):
    rows = spark.createDataFrame([(k, "some words here " * (k % 7)) for k in range(300)], "doc_id long, text string")
    ends = []
    for p in (T.FileParams(segment_ids=10), T.FileParams()):
        got = T.token_file(T.by_doc_id(rows.repartition(5)), p).orderBy("doc_id").collect()
        ends.append([tuple(r) for r in got])
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert ends[0] == ends[1]


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        got = T.token_file(T.by_doc_id(docs)).collect()
        assert len(got) == 11 and min((r.start, r.doc_id) for r in got)[1] is None
        counts = K.token_counts(docs).collect()
        assert sorted(r.n_tokens + 1 for r in counts) == sorted(r.n_tokens for r in got)
        assert {r.doc_id: r.n_bytes for r in counts}[0] == 0 and {r.doc_id: r.over_limit for r in counts}[8]
    assert T.token_file(T.by_doc_id(odd.limit(0))).count() == K.token_counts(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="segment"):
        T.unpack(b"x" * 20)
