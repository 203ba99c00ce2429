"""Fingerprints and language identification against plain restatements that share no code with them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from estatelens.llm.fingerprint import fingerprint_edits, neighbours, op5_fingerprint
from estatelens.llm.language_id import op9_language_id
from tests.conftest import SF_SMALL


def paragraphs(text):
    out = Counter()
    for line in text.split("\n"):
        part = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            part.append(word)
            if word[-1] in ".!?" or len(part) == 8:
                out[tuple(part)] += 1
                part = []
        if part:
            out[tuple(part)] += 1
    return out


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def edits(rows):
    """Rows ``(doc_id, text)`` in the order of the contract, each with its edited text and the next one's text."""
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in line]
    for (d, _), text, after in zip(line, texts, texts[1:] + texts[:1]):
        k = len(text) // 3
        yield d, text, text[:len(text) - k] + after[:k], after


def test_fingerprint_query_against_plain_paragraphs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op5_fingerprint(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    prints = {}
    for d, text, edited, after in edits(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(text, edited), abs=1e-12) and r.near_next == pytest.approx(alike(text, after), abs=1e-12)
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p


def hot_rows(n=1500):
    rng = random.Random(4)
    words = ["alpha", "beta.", "gamma!", "delta", "two\nlines", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + f" {i}" for i in range(n)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(n)]
    return [(d, None if i % 50 == 0 else t) for i, (d, t) in enumerate(zip(ids, texts))]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_null_and_repeated_ids_against_brute_force(spark, partitions):
    rows = hot_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, last int").repartition(6)
    got = fingerprint_edits(docs, partitions).collect()
    want = Counter((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(t, e), 9), round(alike(t, a), 9)) for d, t, e, a in edits(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_null_and_repeated_ids_are_spread(spark):
    """A third of the rows without an id and a third with one id: no range holds much more than its share."""
    docs = spark.createDataFrame(hot_rows(3000), "doc_id long, text string")
    sizes = sorted(r["count"] for r in neighbours(docs, 16).filter("not last").groupBy("part").count().collect())
    assert len(sizes) >= 12 and sizes[-1] <= 2 * 3000 / 16 and sum(sizes) == 3000


def test_extreme_ids(spark):
    rows = [(-2**63, "least one two"), (2**63 - 1, "greatest one"), (0, "middle"), (None, "none"), (-1, None), (0, "middle"), (0, "a middle")]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    want = Counter((d, hashlib.sha256(e.encode()).hexdigest()) for d, _, e, _ in edits(rows))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def grams(text):
    """Character 1- to 3-grams of the lower-cased text with a letter in them; every other character is a blank."""
    chars = "".join(c if c.isalpha() else " " for c in text.lower())
    return Counter(g for n in (1, 2, 3) for i in range(len(chars) - n + 1) if (g := chars[i:i + n]).strip())


def test_language_query_against_plain_naive_bayes(spark):
    """Bayes over the grams themselves, not over hashes of them: hashing may move close calls, no more."""
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, prior = {}, Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            prior[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    vocabulary = 1 << 15
    log = {x: (math.log(prior[x] / sum(prior.values())), math.log(sum(c.values()) + vocabulary / 2), c) for x, c in counts.items()}
    got = {r.doc_id: r for r in op9_language_id(spark, SF_SMALL).collect()}
    same, right, held = 0, 0, 0
    for r in rows:
        found = grams(r.text or "")
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            same += 1
            continue
        score = {x: p + sum(n * (math.log(c[g] + 0.5) - total) for g, n in found.items()) for x, (p, total, c) in log.items()}
        same += got[r.doc_id].lang_pred == max(score, key=score.get)
        if got[r.doc_id].held_out and r.lang:
            held += 1
            right += got[r.doc_id].lang_pred == r.lang
    assert same >= 0.99 * len(rows) and right >= 0.97 * held
