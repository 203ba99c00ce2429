"""Committed runs: whole or not at all, repeated runs replace themselves."""

import datetime as dt
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from estatelens.plans.jobs import run_cheapest_job, run_movers_job
from estatelens.runs import RunStore
from estatelens.sources import listings_from_testdata
from tests.conftest import SF_SMALL

AS_OF = dt.datetime(2024, 1, 15, 9, 30, 5)


@pytest.fixture
def store(spark):
    return RunStore(spark, tempfile.mkdtemp(prefix="estatelens-runs-"))


def rows(spark, *values):
    return spark.createDataFrame([(v, len(v)) for v in values], "text string, n int")


def test_a_repeated_run_replaces_itself(spark, store):
    store.write("r", {"a": (rows(spark, "x", "yy"), "parquet"), "b": (rows(spark, "old").select("text"), "text")})
    store.write("other", {"a": (rows(spark, "z"), "parquet")})
    store.write("r", {"a": (rows(spark, "new"), "parquet"), "b": (rows(spark, "1", "2").select("text").coalesce(1), "text")})
    assert [r.text for r in store.read("r", "a", verify=True).collect()] == ["new"]
    assert [r.text for r in store.read("r", "b", verify=True).collect()] == ["1", "2"]
    assert sorted(r.text for r in store.read_all("a").collect()) == ["new", "z"]
    seen = {(r.run, r.output): (r.version, r.n_rows, r.n_chars) for r in store.manifest().collect()}
    assert seen == {("r", "a"): (2, 1, 3), ("r", "b"): (2, 2, 2), ("other", "a"): (1, 1, 1)}


def test_a_killed_run_is_not_seen(spark, store):
    store.write("r", {"a": (rows(spark, "good"), "parquet"), "b": (rows(spark, "good"), "parquet")})
    dies = rows(spark, "bad").withColumn("n", F.raise_error(F.lit("killed")).cast("int"))
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            store.write("r", {"a": (rows(spark, "half"), "parquet"), "b": (dies, "parquet")})
    assert [r.text for r in store.read("r", "a").collect()] == ["good"]
    assert len(store.vacuum()) == 2 and store.vacuum() == []
    store.write("r", {"a": (rows(spark, "again"), "parquet")})
    assert [r.text for r in store.read("r", "a", verify=True).collect()] == ["again"]
    with pytest.raises(ValueError, match="no committed output 'b'"):
        store.read("r", "b")


def test_a_changed_output_is_found(spark, store):
    path, n = store.write("r", {"a": (rows(spark, "one", "two"), "parquet")})["a"]
    assert n == 2
    os.remove(sorted(glob.glob(path + "/part-*"))[-1])
    with pytest.raises(ValueError, match="isn't what was committed"):
        store.read("r", "a", verify=True)


def test_empty_outputs_and_stores(spark, store):
    assert store.read_all("a") is None and store.manifest().collect() == [] and store.vacuum() == []
    store.write("r", {"a": (rows(spark, "x").limit(0), "parquet")})
    assert store.read("r", "a", verify=True).collect() == [] and store.read("r", "a").columns == ["text", "n"]


def test_jobs_leave_one_report_and_one_set_of_messages(spark, store):
    listings = listings_from_testdata(spark, SF_SMALL)
    results = [run_movers_job(listings, "unused", AS_OF, prefix="movers", store=store) for _ in range(2)]
    assert results[0]["messages"] == results[1]["messages"] > 0
    outbox = store.read_all("outbox")
    assert outbox.count() == results[1]["messages"] == outbox.select("report_id", "part").distinct().count()
    run_movers_job(listings, "unused", AS_OF + dt.timedelta(days=1), prefix="movers", store=store)
    assert store.read_all("outbox").select("report_id").distinct().count() == 2
    assert store.read("movers_20240115_093005", "report", verify=True).count() > 0
    paths = run_cheapest_job(listings, "unused", AS_OF, store=store)
    assert set(paths) == {"markers", "centre", "stats", "top_locations", "chart", "table"}
    assert store.read("lowest_prices_20240115_093005", "top_locations", verify=True).count() == 10
    assert len(store.vacuum()) == 1
