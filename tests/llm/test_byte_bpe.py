"""Byte-level BPE against the library that defines its results, and round trips."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.llm.byte_bpe import RANKS, Encoder, decode, encode, merge, op13_byte_bpe, prepare, read_ranks
from tests.conftest import SF_SMALL

PIECES = regex.compile(public_tokenizers.PATTERN)


def ranks_of(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return read_ranks(f.read())


def library(ranks, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def both():
    ranks = ranks_of(RANKS)
    return Encoder(prepare(ranks)), library(ranks), ranks


def ids_of(encoder, text):
    return [i for m in PIECES.finditer(text) for i in memoryview(encoder[m.group()]).cast("I")]


def test_every_code_point_splits_and_encodes_like_the_library(both):
    encoder, plain, _ = both
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}"
            assert ids_of(encoder, text) == plain.encode_ordinary(text), hex(c)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab", max_size=80), st.text(alphabet="the inga", max_size=120),
                 st.text(alphabet=" \n\t", max_size=60), st.text(alphabet="éàüß'st", max_size=60)))
def test_any_text(both, text):
    encoder, plain, _ = both
    assert ids_of(encoder, text) == plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_tokens_run_together(both, data):
    encoder, plain, ranks = both
    tokens = data.draw(st.lists(st.sampled_from(sorted(ranks)), min_size=1, max_size=8))
    text = b"".join(tokens).decode("utf-8", "replace").replace(" ", "x")
    assert ids_of(encoder, text) == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_011, "ab" * 20_000, "the" * 20_000, " " * 30_000, "é" * 20_000, "qzxj" * 9_999])
def test_very_long_pieces(both, text):
    encoder, plain, _ = both
    assert ids_of(encoder, text) == plain.encode_ordinary(text)


def test_small_memory_changes_nothing(both, monkeypatch):
    encoder, plain, ranks = both
    monkeypatch.setattr("estatelens.llm.byte_bpe.REMEMBERED", 3)
    few = Encoder(prepare(ranks))
    text = "Several different words, repeated: several words and different numbers 12 345 6789." * 3
    assert ids_of(few, text) == plain.encode_ordinary(text)
    assert len(few) <= 3 and few.judged <= 3


def vocabulary(*tokens):
    return {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("tokens", [
    (b"ab", b"cd", b"bc", b"abcd", b"aa", b"aaa"),
    (b"aa", b"ab", b"aab", b"ba", b"bab"),
    (b"bc", b"ab", b"abc", b"bcd"),  # merging "abc" gives the token by "bc"
    (b"ab", b"xyz", b"aba"),  # "xyz" can't be merged: only a piece that is it has its id
])
@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abcdxyz", max_size=14))
def test_small_vocabularies_by_plain_merging(tokens, text):
    ranks = vocabulary(*tokens)
    encoder, piece = Encoder(prepare(ranks)), text.encode()
    expected = [ranks[piece]] if piece in ranks else [ranks[t] for t in merge(piece, ranks)]
    assert list(memoryview(encoder[text]).cast("I")) == expected


def test_unfit_vocabularies_are_refused():
    with pytest.raises(ValueError, match="lacks the bytes"):
        prepare({b"a": 0})
    ranks = vocabulary(b"ab", b"abc") | {b"ab": 300}
    with pytest.raises(ValueError, match="ranks before"):
        prepare(ranks)


def test_rows_of_every_kind(spark):
    texts = [None, "", "a", "a", "  two  words\n", "naïve café 東京 🙂", "x" * 200_000, "<|endoftext|>", "'ll 12"]
    rows = [(None if i == 3 else i, t, "old", b"old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, IDS binary")
    out = encode(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    got = {r.doc_id: r for r in decode(out.withColumn("decoded", F.lit("old")).withColumn("raw", F.col("ids"))).collect()}
    plain = library(ranks_of(RANKS))
    for i, text in ((None if i == 3 else i, t) for i, t in enumerate(texts)):
        ids = plain.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert list(memoryview(bytes(got[i].raw)).cast("I")) == ids
        assert bytes(got[i].decoded) == (text or "").encode()
    assert encode(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(decode(nothing).first().decoded) == b""


def test_another_vocabulary_and_pattern(spark):
    name, pattern = "byte_bpe_multi_50k.tiktoken", r"(\w+)|\W"
    docs = spark.createDataFrame([("Größe, 東京; naïve",), ("x" * 70_000 + " y",)], "text string")
    plain = library(ranks_of(name), pattern)
    got = [list(memoryview(bytes(r.ids)).cast("I")) for r in encode(docs, path=public_tokenizers.path(name), pattern=pattern).collect()]
    assert got == [plain.encode_ordinary(r.text) for r in docs.collect()]


def test_query_against_the_library(spark):
    sf_dir = SF_SMALL
    plain = library(ranks_of(RANKS))
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    out = op13_byte_bpe(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == want


def test_rank_files_are_read_line_by_line():
    raw = b"\n".join([base64.b64encode(b"a") + b" 0", base64.b64encode(b" b") + b" 7", b""])
    assert read_ranks(raw) == {b"a": 0, b" b": 7}
