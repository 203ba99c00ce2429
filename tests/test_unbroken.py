"""The unbroken queries work on whole documents of both kinds: without white space, and as they are."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from estatelens.operators import textprep as tp
from estatelens.plans.registry import AS_OF
from tests import pyref
from tests.test_oracle import bag

PROSE = "\n".join(f"Line {i} of a text. It has two sentences, and words to cut at." for i in range(150))
LONG_LINE = "One sentence of a line. " * 200 + "word " * 900
TEXTS = [PROSE, LONG_LINE, "ab " * 1500, "x" * 2999, "x" * 3000, "x" * 7001, " \n\t\r ", "", None]
DOCS = [(3 * i + kind, t) for i, t in enumerate(TEXTS) for kind in range(3)] + [(None, PROSE), (-1, PROSE)]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("unbroken"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def expected():
    """``(doc_id, chunks)`` by the plain packer."""
    for doc_id, text in DOCS:
        if text is not None:
            yield doc_id, pyref.chunks(re.sub(r"[ \n\r\t]+", "", text) if doc_id is not None and doc_id >= 0 and doc_id % 3 < 2 else text)


def same_as_sql(df, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    found = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(columns, found.fetchall())


def test_chunk_unbroken_keeps_plain_texts_whole(spark, documents):
    got = E.queries()["chunk_unbroken"](spark, documents)
    rows = [(doc_id, part, len(cs), c, len(c)) for doc_id, cs in expected() for part, c in enumerate(cs)]
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(["doc_id", "part", "n_parts", "chunk", "n_chars"], rows)
    same_as_sql(got, documents, "chunk_unbroken")


def test_messages_unbroken_frame_plain_texts_whole(spark, documents):
    got = E.queries()["messages_unbroken"](spark, documents)
    header, footer = tp.message_header(AS_OF), tp.message_footer()
    framed = [(doc_id, part, len(cs), header * (part == 0) + c + footer * (part == len(cs) - 1)) for doc_id, cs in expected() for part, c in enumerate(cs)]
    rows = [(doc_id, part, n, t if len(t) <= 4000 else t[:3997] + "...", len(t) > 4000) for doc_id, part, n, t in framed]
    columns = ["report_id", "part", "n_parts", "text", "was_trimmed"]
    assert bag(columns, [tuple(r) for r in got.select(*columns).collect()]) == bag(columns, rows)
    assert {r.was_trimmed for r in got.filter("report_id % 3 = 2 AND report_id < 3").collect()} == {False}
    same_as_sql(got, documents, "messages_unbroken")
