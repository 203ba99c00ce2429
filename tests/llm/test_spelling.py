"""Spelling variants against plain counting and plain edit distances."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.llm.spelling import neighbourhood, one_edit_pairs, op12_spelling, reduced, roots, spelling_variants, word_counts
from tests.conftest import SF_SMALL

LOWER = {c: c + 32 for c in range(65, 91)}


def counts(rows, min_length=6, min_count=5, slip=None):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= min_count}


def near(a, b):
    """Whether one insertion, deletion or replacement makes ``a`` into ``b``, by trying all places."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(words, ratio=5):
    form = {}
    around = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(around[w]), words.get(form[w]))
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("symbols, long", [(2, 40), (8, 40), (8, 5), (16, 8)])
def test_random_words_against_brute_force(spark, symbols, long):
    rng = random.Random(symbols * long)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abcdé÷ÿ") for _ in range(rng.randint(3, 14)))
        words[base] = rng.choice([3, 40, 400, 5000])
        for _ in range(4):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            c = rng.choice("abcdéß")
            words[(base[:at] + c + base[at:], base[:at] + base[at + 1:], base[:at] + c + base[at + 1:])[kind] or "a"] = rng.choice([1, 2, 9, 2000])
    got = rows_of(spelling_variants(frame(spark, words), symbols=symbols, long=long))
    assert got == variants(words)
    assert any(r[0] for r in got.values()) and any(r[0] and r[1] != r[0] for r in got.values())


def test_pairs_come_once_in_both_directions(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "zzzzzz", "a" * 41, "a" * 42, "a" * 40, "ab" * 50, "ab" * 50 + "a", "x" + "ab" * 50, "a" * 20 + "c" + "a" * 20]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [(r.word, r.near) for r in one_edit_pairs(df).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_a_very_long_word(spark):
    words = {"q" * 60_000: 50, "q" * 59_999: 5, "q" * 30_000 + "r" + "q" * 29_999: 7, "plain words".replace(" ", ""): 9}
    assert rows_of(spelling_variants(frame(spark, words))) == {w: v for w, v in variants(words).items()}


def test_ties_go_to_the_smaller_code_point(spark):
    words = {"bcdefg": 1, "zbcdefg": 10, "ébcdefg": 10, "abcdefg": 9}
    assert rows_of(spelling_variants(frame(spark, words)))["bcdefg"][0] == "zbcdefg"


def test_the_ratio_is_met_exactly(spark):
    got = rows_of(spelling_variants(frame(spark, {"colour": 5, "color": 25, "colouri": 24, "neighbour": 6, "neighbor": 29})))
    assert got["colour"][:2] == ("color", "color") and got["neighbour"][:2] == (None, "neighbour")
    with pytest.raises(ValueError, match="circles"):
        spelling_variants(frame(spark, {"a": 1}), ratio=1)


def test_chains_of_forms(spark):
    chain = [("w%02d" % i, "w%02d" % (i + 1)) for i in range(23)] + [("x", "w05"), ("y", "z")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i:02d}": "w23" for i in range(23)} | {"x": "w23", "y": "z"}


def test_empty_words(spark):
    assert spelling_variants(frame(spark, {"a": 1}).limit(0)).collect() == []


@settings(max_examples=15, deadline=None)
@given(word=st.text(alphabet="abcdefgé÷", min_size=1, max_size=7))
def test_neighbourhood_covers_every_edit(spark, word):
    """Whatever one edit makes of the word, its reduced form is in the neighbourhood of the word's own."""
    edits = {word} | {word[:i] + word[i + 1:] for i in range(len(word))} - {""}
    edits |= {word[:i] + c + word[i + k:] for i in range(len(word) + 1) for c in "aß" for k in (0, 1)}
    df = spark.createDataFrame([(word, sorted(edits))], "word string, edits array<string>")
    r = df.select(neighbourhood(reduced(F.col("word"), 4), 4).alias("around"), F.transform("edits", lambda e: reduced(e, 4)).alias("forms")).first()
    assert set(r.forms) <= set(r.around) and len(r.around) == len(set(r.around))


def test_counts_of_every_kind_of_text(spark, monkeypatch):
    rows = [(1, None), (2, ""), (None, "Straße STRASSE strasse"), (3, "naïveté " * 7), (3, "naïveté " * 7), (4, "ÀÉÎÕÜ× àéîõü÷ Ÿpsilon"),
            (5, "abcde abcdef abcdefg"), (6, "Łódźkowski İstanbul")] + [(i, "Repeated words repeat: repeated, Words") for i in range(10, 60)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n long")
    for slip in (None, 3, 1):
        for least in (1, 5):
            got = {r.word: r.n for r in word_counts(docs, slip=slip, min_count=least).collect()}
            assert got == counts(rows, min_count=least, slip=slip)
    assert word_counts(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 7))) for _ in range(150_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.word: r.n for r in word_counts(docs, slip=199).collect()} == counts([(1, text)], slip=199)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op12_spelling(spark, SF_SMALL)) == variants(counts(rows, slip=199))
