"""Native decoding of character references against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from estatelens.functions.entities import NUMERIC_RE, unescape


def same(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.u for r in df.select("i", unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != (None if t is None else html.unescape(t))]
    assert not wrong, wrong[:5]


def test_every_name_with_and_without_semicolon(spark):
    texts = []
    for name in html5:
        bare = name.rstrip(";")
        texts += [f"&{name}", f"x&{bare}y &{bare};", f"&{bare}zz;", f"&{name[:-1]}", f"&{bare}&{name}"]
    same(spark, texts)


def test_numbers(spark):
    special = [0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, *range(0xD7FE, 0xE002, 5), 0x10FFFF, 0x110000, 99_999_999, 10**9, 10**30]
    special += [plane * 0x10000 + end for plane in range(17) for end in (0, 0xFFFD, 0xFFFE, 0xFFFF)]
    texts = [form.format(n) for n in [*range(400), *special] for form in ("&#{};", "&#x{:x};", "&#X{:X}", "&#000{}a", "&#{}&#{};".replace("{}", "{0}"))]
    same(spark, texts)


def test_no_references(spark):
    same(spark, [None, "", "plain", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&\n&", "&#", "&-amp;", "&é;", "a & b && c", "&amp", "&ampamp;", "&notit;", "&" * 50_000,
                 "&lt;" * 20_000])


def test_random_texts(spark):
    rng = random.Random(7)
    pieces = ["&", "&", "#", "x", "X", "amp", "lt", ";", "a", "19", "F", " ", "\n", "not", "in", "é", "<", "copy", "Aacute", "🙂", "notin", "\t"]
    same(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(20_000)])
    assert NUMERIC_RE.startswith("#")
