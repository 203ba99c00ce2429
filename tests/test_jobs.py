"""The end-to-end jobs write every sink; outputs agree with the queries."""

import datetime as dt
import glob
import tempfile

from estatelens.plans.jobs import run_cheapest_job, run_movers_job, run_name
from estatelens.plans.registry import QUERIES
from estatelens.sources import listings_from_testdata
from tests import pyref
from tests.conftest import SF_SMALL

AS_OF = dt.datetime(2024, 1, 15, 9, 30, 5)


def test_run_name():
    assert run_name("price_changes", AS_OF) == "price_changes_20240115_093005"


def test_movers_job(spark):
    out = tempfile.mkdtemp(prefix="estatelens-job-")
    res = run_movers_job(listings_from_testdata(spark, SF_SMALL), out, AS_OF, 40.0, 60.0,
                         prefix="medium_flats", footer="\nown footer", tags="#own")
    assert res["report"].endswith("medium_flats_20240115_093005/report")
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(res["report"] + "/part-*")))
    report = text[:-1]  # the text sink ends every row with a newline
    outbox = spark.read.parquet(res["outbox"]).orderBy("part").collect()
    assert res["messages"] == len(outbox) > 0
    # the outbox is the whole report, sanitised and greedily chunked
    assert [r.part for r in outbox] == list(range(len(outbox)))
    expect = pyref.chunks(pyref.sanitize(report))
    assert len(outbox) == len(expect)
    middle = [r.text for r in outbox]
    assert middle[0].endswith(expect[0]) or len(expect) == 1
    assert middle[1:-1] == expect[1:-1]
    assert middle[-1].endswith(expect[-1] + "\nown footer#own")


def test_cheapest_job(spark):
    out = tempfile.mkdtemp(prefix="estatelens-job-")
    paths = run_cheapest_job(listings_from_testdata(spark, SF_SMALL), out, AS_OF)
    assert set(paths) == {"markers", "centre", "stats", "top_locations", "chart", "table"}
    assert spark.read.parquet(paths["markers"]).count() == QUERIES["markers"](spark, SF_SMALL).count()
    assert spark.read.parquet(paths["top_locations"]).count() == 10


def test_run_all(spark):
    from estatelens.plans.jobs import run_all
    out = tempfile.mkdtemp(prefix="estatelens-job-")
    res = run_all(listings_from_testdata(spark, SF_SMALL), out, AS_OF)
    assert res["small"]["messages"] > 0 and res["medium"]["messages"] > 0
    assert set(res["cheapest"]) == {"markers", "centre", "stats", "top_locations", "chart", "table"}
    assert res["small"]["report"] != res["medium"]["report"]


def test_cli(spark):
    from estatelens.plans.cli import main
    out = tempfile.mkdtemp(prefix="estatelens-cli-")
    res = main(["--testdata", SF_SMALL, "--out", out, "--job", "small", "--as-of", "2024-01-15T09:30:05",
                "--land", "cli_landed", "--buckets", "4"], spark)
    assert res["report"].endswith("movers_small_20240115_093005/report") and res["messages"] > 0
    # same listings through the generic reader
    src = tempfile.mkdtemp(prefix="estatelens-cli-") + "/listings"
    listings_from_testdata(spark, SF_SMALL).write.parquet(src)
    res2 = main(["--listings", src, "--out", out, "--job", "cheapest", "--as-of", "2024-01-15T09:30:05"], spark)
    assert set(res2) == {"markers", "centre", "stats", "top_locations", "chart", "table"}
