"""Streaming outbox and the batch sinks, written to fresh scratch folders."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from estatelens import sinks
from estatelens.plans.registry import QUERIES
from estatelens.plans.reports import movers_report
from estatelens.sources import listings_from_testdata
from estatelens.streaming import outbox_stream
from tests import pyref
from tests.conftest import SF_SMALL


def scratch():
    return tempfile.mkdtemp(prefix="estatelens-test-")


def test_outbox_stream_matches_batch(spark):
    root = scratch()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src = os.path.join(root, "in")
    docs.write.parquet(src)
    q = outbox_stream(spark, src, docs.schema, os.path.join(root, "out"), os.path.join(root, "ckpt"),
                      as_of=dt.datetime(2024, 1, 15, 9, 30))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(root, "out"))
    expect = QUERIES["messages"](spark, SF_SMALL)
    cols = ["report_id", "part", "n_parts", "text", "n_chars", "was_trimmed", "retry_text"]
    assert got.select(*cols).exceptAll(expect.select(*cols)).count() == 0
    assert expect.select(*cols).exceptAll(got.select(*cols)).count() == 0
    # chunk texts agree with the plain-Python pipeline
    row = docs.orderBy("doc_id").first()
    n = len(pyref.chunks(pyref.sanitize(row.text)))
    assert got.filter(F.col("report_id") == row.doc_id).count() == n


def test_report_and_outbox_sinks(spark):
    root = scratch()
    rep = movers_report(listings_from_testdata(spark, SF_SMALL), 0.0, 40.0, match="latest")
    path = os.path.join(root, "report")
    sinks.write_report(rep.rows, path)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(path + "/part-*")))
    assert text.startswith(rep.rows.filter("seq = 0").first().text)
    n_loc = rep.location_blocks.count()
    assert text.count("\n== ") + text.startswith("== ") == n_loc
    tbl = os.path.join(root, "table")
    sinks.write_report_table(QUERIES["formatted_cheapest"](spark, SF_SMALL), tbl)
    assert spark.read.parquet(tbl).count() == QUERIES["formatted_cheapest"](spark, SF_SMALL).count()
    obs_df, obs = sinks.observe_count(rep.movers)
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == rep.movers.count()
    assert not sinks.is_empty(rep.movers)


def test_outbox_stream_many_batches(spark):
    """Several input files, one per trigger: every batch lands in its own
    folder and together they equal the batch job."""
    root = scratch()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src = os.path.join(root, "in")
    docs.repartition(4, "doc_id").write.parquet(src)
    n_files = len(glob.glob(src + "/part-*.parquet"))
    q = outbox_stream(spark, src, docs.schema, os.path.join(root, "out"), os.path.join(root, "ckpt"),
                      as_of=dt.datetime(2024, 1, 15, 9, 30), max_files_per_trigger=1)
    q.awaitTermination(300)
    batches = glob.glob(os.path.join(root, "out", "batch_id=*"))
    assert len(batches) == n_files > 1
    got = spark.read.parquet(os.path.join(root, "out")).drop("batch_id")
    expect = QUERIES["messages"](spark, SF_SMALL).select(*got.columns)
    assert got.exceptAll(expect).count() == 0 and expect.exceptAll(got).count() == 0
