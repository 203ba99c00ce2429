"""The newest rows by a threshold: the same rows as by a heap, from fewer row groups."""

import datetime as dt
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from estatelens.operators.filters import most_recent, newest_day, positive_price
from estatelens.sources.schema import LISTING_SCHEMA


def listings(spark, n, nulls=0, days=60, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = None if i < nulls else dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, days), hours=rng.choice([0, 0, 23]))
        rows.append((i, "t", rng.choice([0.0, 5.0, 7.0]), 1, 30.0, "A", "u", at, None, rng.randint(0, 3), 0))
    return spark.createDataFrame(rows, LISTING_SCHEMA)


@pytest.mark.parametrize("nulls", [0, 3, 50])
@pytest.mark.parametrize("n", [1, 10, 40, 5000])
def test_same_rows(spark, nulls, n):
    df = listings(spark, 400, nulls)
    assert most_recent(df, n, method="threshold").collect() == most_recent(df, n).collect()


def test_one_day_and_no_rows(spark):
    same = listings(spark, 100, days=0)
    assert most_recent(same, 7, method="threshold").collect() == most_recent(same, 7).collect()
    assert most_recent(same.limit(0), 7, method="threshold").collect() == []
    assert newest_day(same.limit(0), 7) is None and newest_day(listings(spark, 20, nulls=20), 7) == ""
    with pytest.raises(ValueError, match="unknown method"):
        most_recent(same, 7, method="best")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu"])
def test_days_do_not_depend_on_the_time_zone(spark, zone):
    df, before = listings(spark, 300, 2), spark.conf.get("spark.sql.session.timeZone")
    want = most_recent(df, 25).collect()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert most_recent(df, 25, method="threshold").collect() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def rows_read(df):
    """Rows that came out of the file scan, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_fewer_row_groups_of_a_time_sorted_copy(spark):
    path = tempfile.mkdtemp(prefix="estatelens-sorted-") + "/listings.parquet"
    zoned = listings(spark, 20_000, days=400).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    pq.write_table(zoned.orderBy("updated_at").toArrow(), path, row_group_size=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = positive_price(spark.read.parquet(path))
        heap, threshold = most_recent(stored, 300), most_recent(stored, 300, method="threshold")
        assert heap.collect() == threshold.collect()
        plan = threshold._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(updated_at" in plan
        assert rows_read(threshold) < rows_read(heap) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
