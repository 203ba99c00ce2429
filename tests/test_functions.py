"""Column functions on the hand-derived edge cases of FIXTURES.md section 4."""

import datetime as dt
import random
import re

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.functions import fmt
from estatelens.functions.chunk import pack_chunks
from estatelens.functions.geo import parse_geography
from estatelens.functions.html import sanitize
from tests import pyref


def one_col(spark, values, ddl):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")


def collect(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


GEO_CASES = [
    ("Широта: 25.1, Долгота: 55.2", 25.1, 55.2),
    ("25.1,55.2", 25.1, 55.2),
    ("Широта: 25.1,Долгота: 55.2", None, None),
    ("Широта: 25,1, Долгота: 55,2", None, None),
    ("25.1", None, None),
    ("25.1,x", None, None),
    ("1e1,-2", 10.0, -2.0),
    ("25.1d,55.2", None, None),
    ("nan,55.2", None, None),
    ("", None, None),
    (None, None, None),
    ("  25.5 , 55.5 ", 25.5, 55.5),
    (".5,5.", 0.5, 5.0),
]


def test_parse_geography(spark):
    df = one_col(spark, [c[0] for c in GEO_CASES], "string")
    lat, lon = parse_geography("v")
    got = [(r[0], r[1]) for r in df.orderBy("i").select(lat, lon).collect()]
    assert got == [(c[1], c[2]) for c in GEO_CASES]


SAN_CASES = [
    ("&lt;b&gt;x&lt;/b&gt;", "x"),
    ("a & b", "a &amp; b"),
    ("&copy 1", "© 1"),
    ("<>", "&lt;&gt;"),
    ("1<2", "1&lt;2"),
    ("a\u0007\tb", "a\tb"),
    ("<p\nclass='x'>t</p>", "t"),
    ("\u0085x\u009f", "x"),
    (None, None),
]


def test_sanitize_cases(spark):
    df = one_col(spark, [c[0] for c in SAN_CASES], "string")
    assert collect(df, sanitize("v")) == [c[1] for c in SAN_CASES]


def test_sanitize_pages_match_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", sanitize("html").alias("s")).collect():
        assert r.s == pyref.sanitize(r.html)


CHUNK_CASES = [
    ("a" * 3000, [0, 3000]),
    ("x" * 3500, [0, 3500]),
    ("", []),
    ("\n\n", []),
    ("p1\n" + "w " * 2000 + ". Next! z\nlast", [2998, 1018]),
    ("s. " * 1200 + "\n  ID: 1", [2999, 608]),
]


def test_chunk_cases(spark):
    df = one_col(spark, [c[0] for c in CHUNK_CASES], "string")
    got = collect(df, pack_chunks("v"))
    assert [[len(c) for c in g] for g in got] == [c[1] for c in CHUNK_CASES]
    assert got == [pyref.chunks(c[0]) for c in CHUNK_CASES]


def test_chunk_null(spark):
    df = one_col(spark, [None], "string")
    assert collect(df, pack_chunks("v")) == [None]


def test_chunk_documents_match_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for m in (3000, 150):
        for r in docs.select("text", pack_chunks("text", m).alias("c")).collect():
            assert r.c == pyref.chunks(r.text, m)


PIECES = list("ab .!?\n") + [" ", "\t", "\u00a0", "xyz", "Q.", "&", "<i>"]


def _texts(rng, n):
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def _check_chunks(text, chunks, max_length):
    assert chunks == pyref.chunks(text, max_length)
    # Smallest packing units are the space/LF-separated tokens; if none is over
    # the limit, no chunk is, and the whitespace-separated words keep their order.
    if all(len(t) <= max_length for t in re.split(r"[ \n]", text)):
        assert all(len(c) <= max_length for c in chunks)
    assert [w for c in chunks for w in c.split()] == text.split()


def test_chunk_property_batch(spark):
    """Differential + invariants on 600 random texts, one Spark job per limit."""
    rng = random.Random(11)
    for max_length in (3, 7, 13, 40):
        texts = _texts(rng, 150)
        got = collect(one_col(spark, texts, "string"), pack_chunks("v", max_length))
        for text, chunks in zip(texts, got):
            _check_chunks(text, chunks, max_length)


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), min_size=1, max_size=20),
       st.integers(min_value=3, max_value=40))
def test_chunk_property(spark, texts, max_length):
    got = collect(one_col(spark, texts, "string"), pack_chunks("v", max_length))
    for text, chunks in zip(texts, got):
        _check_chunks(text, chunks, max_length)


def test_money_and_numbers(spark):
    df = one_col(spark, [0.125, 2.675, 1234567.885, None], "double")
    assert collect(df, fmt.money("v")) == ["0.12", "2.67", "1,234,567.89", "0.00"]
    df = one_col(spark, [1999.99], "double")
    assert collect(df, fmt.whole_money("v")) == ["1,999 AED"]
    assert collect(df, fmt.fixed("v", 1)) == ["2000.0"]


def test_rooms(spark):
    df = one_col(spark, ["2.7", None, "Studio", "3"], "string")
    assert collect(df, fmt.int_or_zero("v")) == [2, 0, 0, 3]


def test_signed_pct_and_date(spark):
    df = one_col(spark, [3.456, -2.1, None], "double")
    assert collect(df, fmt.signed_pct("v")) == ["▲ +3.46%", "▼ -2.10%", "▼ 0.00%"]
    df = one_col(spark, [dt.datetime(2024, 3, 5, 1, 2, 3)], "timestamp_ntz")
    assert collect(df, fmt.date_text("v")) == ["05.03.2024"]
    df = one_col(spark, ["2024-03-05 01:02:03", "soon", "", None], "string")
    assert collect(df, fmt.date_text("v")) == ["05.03.2024", "soon", "", None]


def test_html_escape_and_link(spark):
    df = one_col(spark, ['a&b<c>"'], "string")
    assert collect(df, fmt.html_escape("v")) == ["a&amp;b&lt;c&gt;&quot;"]
    assert collect(df, fmt.link(F.lit("u"))) == ['<a href="u" target="_blank">Open</a>']


SAN_PIECES = ["<", ">", "&", "&amp;", "&lt;", "&copy", "&#62;", "&#x3c;", "a", " ", "\n", "b>", "<i", "\x07", "\x85",
              "é", ";"]


def test_sanitize_property_batch(spark):
    """No < or > survives; every & begins an entity the sanitiser wrote;
    and the result equals the plain-Python statement."""
    rng = random.Random(23)
    texts = ["".join(rng.choice(SAN_PIECES) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = collect(one_col(spark, texts, "string"), sanitize("v"))
    for text, out in zip(texts, got):
        assert out == pyref.sanitize(text)
        assert "<" not in out and ">" not in out
        assert re.fullmatch(r"([^&]|&(amp|lt|gt);)*", out, re.S)


GEO_PIECES = ["Широта: ", " Долгота: ", "Долгота: ", "25", ".", "1", ",", " ", "-", "e", "x", "nan", "+", " "]


def test_geography_property_batch(spark):
    """Both coordinates or neither, and a parsed value is a plain number
    that Python reads the same way."""
    rng = random.Random(29)
    texts = ["".join(rng.choice(GEO_PIECES) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    lat, lon = parse_geography("v")
    rows = one_col(spark, texts, "string").orderBy("i").select(lat, lon).collect()
    for text, (a, b) in zip(texts, rows):
        assert (a is None) == (b is None)
        if a is not None:
            parts = text.replace("Широта: ", "").replace(" Долгота: ", "").split(",")
            assert len(parts) == 2 and (float(parts[0].strip()), float(parts[1].strip())) == (a, b)


def test_texts_of_about_the_chunk_length(spark):
    """A run of exactly the length first closes an empty chunk; longer ones stay whole."""
    texts = ["x" * n for n in (2998, 2999, 3000, 3001, 9000)] + ["x" * 3000 + " y", "y " + "x" * 3000]
    df = one_col(spark, texts, "string")
    got = collect(df, pack_chunks("v", 3000))
    assert got == [pyref.chunks(t, 3000) for t in texts]
    assert got[1] == ["x" * 2999] and got[2] == ["", "x" * 3000]
