"""The distributed whole-document packer equals the sequential greedy packer
run on the joined string, for any partitioning."""

import random

import numpy as np
import pytest

from estatelens.operators import longtext
from estatelens.operators.longtext import Transfer, pack_document, pack_documents
from tests import pyref

PIECES = list("ab .!?") + ["\n", "\n", " ", "xyz", "Q.", "aaaaaaaaaa", "\t", " "]


def run(spark, texts, m, partitions):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    out = pack_document(df, ["k"], "text", m, partitions=partitions).orderBy("part").collect()
    assert all(r.n_parts == len(out) for r in out)
    return [r.chunk for r in out]


@pytest.mark.parametrize("texts,m", [
    (["a" * 10, "b"], 10),                      # first unit flushes an empty chunk
    (["abc", "   ", "\n\n", " "], 5),           # final chunk is whitespace only
    (["x" * 30, "y y y", "   \n  "], 8),        # oversize word, blank tail over partitions
    (["", ""], 5),                               # nothing but newlines
    (["one. two! three? four"] * 5, 9),          # sentence and word levels
])
@pytest.mark.parametrize("partitions", [1, 4])
def test_pack_document_cases(spark, texts, m, partitions):
    assert run(spark, texts, m, partitions) == pyref.chunks("\n".join(texts), m)


def test_pack_document_random(spark):
    rng = random.Random(5)
    for _ in range(10):
        m = rng.choice([5, 12, 30, 80])
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
        assert run(spark, texts, m, rng.choice([1, 3, 7])) == pyref.chunks("\n".join(texts), m)


def test_pack_document_empty(spark):
    df = spark.createDataFrame([], "k int, text string")
    assert pack_document(df, ["k"], "text", 10).count() == 0


def test_pack_document_corpus_many_partitions(spark):
    """All fixture documents as one document, forced over many partitions."""
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    joined = "\n".join(r.text for r in docs.orderBy("doc_id").collect())
    for m in (3000, 400):
        got = pack_document(docs, ["doc_id"], "text", m, units_per_partition=300).orderBy("part").collect()
        assert [r.chunk for r in got] == pyref.chunks(joined, m)


def test_report_sanitised_per_block(spark):
    """Documented deviation: each block is sanitised on its own, so a '<' in one
    block never pairs with a '>' in a later block (whole-string sanitising
    would strip everything in between as one tag)."""
    from estatelens.plans.reports import report_messages
    rows = spark.createDataFrame([(0, None, "Title\n"), (1, "A", "flat <40 sq m\n"), (1, "B", "studio >2 rooms\n")],
                                 "seq int, location string, text string")
    out = report_messages(rows, "r", "H\n", "").orderBy("part").collect()
    text = "".join(r.text for r in out)
    assert "flat &lt;40 sq m" in text and "studio &gt;2 rooms" in text
    whole = pyref.sanitize("\n".join(["Title\n", "flat <40 sq m\n", "studio >2 rooms\n"]))
    assert "studio" not in whole  # what whole-string sanitising would have done


def _frame(chunks, header, footer, max_chars=4000):
    out = []
    for i, c in enumerate(chunks):
        t = (header + c if i == 0 else c) + (footer if i == len(chunks) - 1 else "")
        out.append(t[:max_chars - 3] + "..." if len(t) > max_chars else t)
    return out


def test_report_messages_random_blocks(spark):
    """End to end against plain Python: sanitise the joined report, pack it,
    frame it. Blocks carry entities, quotes, controls, unicode spaces, emoji,
    long words and sentence punctuation (no tag spans two blocks)."""
    from estatelens.plans.reports import report_messages
    rng = random.Random(41)
    pieces = ["word", " ", " ", "\n", "&amp;", "&copy", "\"q\"", " ", "\u0007", "📈", "x" * 120, ". ", "! ",
              "<b>", "</b>", "é", "   ", "\t"]
    for trial in range(4):
        m = rng.choice([60, 200, 3000])
        blocks = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 25))]
        rows = [(0, None, "Report title\n")] + [(1, f"L{i:03d}", b) for i, b in enumerate(blocks)]
        df = spark.createDataFrame(rows, "seq int, location string, text string")
        got = [r.text for r in report_messages(df, "r", "H\n\n", "\nF", max_length=m).orderBy("part").collect()]
        joined = "\n".join(t for _, _, t in rows)
        assert got == _frame(pyref.chunks(pyref.sanitize(joined), m), "H\n\n", "\nF")


@pytest.mark.parametrize("fan", [2, 64])
@pytest.mark.parametrize("units", [3, 10_000])
def test_many_documents_at_once(spark, monkeypatch, fan, units):
    """Long, short, empty and null documents side by side, through trees of several levels."""
    monkeypatch.setattr(longtext, "FAN", fan)
    rng, rows = random.Random(units + fan), []
    for doc in range(12):
        for line in range(rng.choice([1, 2, 60])):
            rows.append((f"d{doc}", line, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))))
    rows += [("none", 0, None), ("none", 1, None), ("blank", 0, " "), ("first", 0, "x" * 25), ("first", 1, None), ("first", 2, "y"), (None, 0, "a b"), (None, 1, "c " * 40)]
    rows += [("hot", i, rng.choice(["word word", "x" * 25, "", "   ", "One. Two! " * 4])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, at int, text string").repartition(5)
    got = {}
    for r in pack_documents(df, "doc", ["at"], "text", 20, units_per_segment=units).collect():
        got.setdefault(r.doc, []).append((r.part, r.n_parts, r.chunk))
    want = {}
    for doc in {r[0] for r in rows}:
        lines = [t for d, _, t in sorted(r for r in rows if r[0] == doc) if t is not None]
        chunks = pyref.chunks("\n".join(lines), 20) if lines else []
        if chunks:
            want[doc] = [(i, len(chunks), c) for i, c in enumerate(chunks)]
    assert {d: sorted(c) for d, c in got.items()} == want


def test_transfer_functions_compose():
    """The function of two runs joined is the composition of theirs, for every incoming state."""
    rng = random.Random(3)
    for _ in range(400):
        m = rng.randint(1, 25)
        runs = [([rng.randint(1, rng.choice([3, 30])) for _ in range(rng.randint(1, 12))]) for _ in range(2)]
        texts = [[rng.random() < 0.4 for _ in run] for run in runs]
        a, b = (longtext._transfer(np.array(w), np.array(t), m) for w, t in zip(runs, texts))
        both = a.then(m, b)
        whole = longtext._transfer(np.array(runs[0] + runs[1]), np.array(texts[0] + texts[1]), m)
        assert len(both.lo) <= m + 1
        for state in range(m + 1):
            for text in (False, True):
                length, flushes, held = state, 0, text
                for w, t in zip(runs[0] + runs[1], texts[0] + texts[1]):
                    if length + w > m:
                        length, flushes, held = 0, flushes + 1, False
                    length, held = min(m, length + w), held or t
                for f in (both, whole):
                    got = [x[0] for x in f.apply(m, state, 0, text)]
                    assert (min(m, got[0]), got[1], bool(got[2])) == (length, flushes, held)


def test_pieces_stay_few():
    """Composing any number of functions keeps at most a piece per state."""
    rng, m = random.Random(1), 50
    f = Transfer(0, False, [], [], [], [], [])
    for _ in range(200):
        f = f.then(m, longtext._transfer(np.array([rng.randint(1, 9) for _ in range(3)]), np.array([True] * 3), m))
        assert len(f.lo) <= m + 1
