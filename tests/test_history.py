"""The price history with ids cut into ranges equals plain lines per id."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators.changes import latest_changes, price_changes, price_history
from estatelens.operators.ranges import cut_ranges
from estatelens.sources.schema import LISTING_SCHEMA


@pytest.fixture(scope="module")
def listings(spark):
    rng, rows = random.Random(3), []
    for n in range(600):
        i = 1 if n % 3 else rng.randint(2, 40)     # id 1 holds two thirds of the rows
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 50) if n % 5 else 20)
        price = rng.choice([0.0, 10.0, 20.0, 30.0 + n])
        rows.append((i, "t", price, 1, 30.0, "A", "u", day if n % 17 else None, None, rng.randint(0, 5), n % 4))
    return spark.createDataFrame(rows, LISTING_SCHEMA)


def lines(listings):
    by = {}
    for r in listings.collect():
        if r.price and r.price > 0 and r.updated_at:
            by.setdefault(r.id, []).append((r.updated_at, r.seq1, r.seq2, r.price))
    out = []
    for i, line in by.items():
        line.sort(reverse=True)
        for n, (t, a, b, p) in enumerate(line):
            before = line[n + 1] if n + 1 < len(line) else (None, None, None, None)
            out.append((i, p, t, a, b, before[3], before[0], n + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split_rows", [1, 7, 50, 2_000_000])
def test_hot_id(spark, listings, split_rows):
    cols = ["id", "price", "updated_at", "seq1", "seq2", "prev_price", "prev_updated_at", "rn"]
    got = price_history(listings, split_rows=split_rows).select(*cols)
    assert sorted(map(tuple, got.collect()), key=repr) == lines(listings)


def test_hot_id_is_spread(spark, listings):
    """The window runs on (id, range), so a hot id's rows are in several partitions."""
    plan = price_history(listings, split_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "_range" in plan


def test_methods_agree(spark, listings):
    a, b = (sorted(map(tuple, latest_changes(listings, method=m).collect()), key=repr) for m in ("top2", "window"))
    assert a == b and a


def test_fan_out_join_can_be_split(spark, listings):
    """Both sides of the self-join are plain shuffles on its key, which AQE can split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = price_changes(listings, 0, 40, match="all")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin"):]
    assert "hashpartitioning(_changed" in join


def test_hot_id_within_one_second(spark):
    """Observations that share their second are told apart by the rest of the order."""
    rng = random.Random(5)
    rows = [(1, "t", float(rng.randint(1, 9)), 1, 30.0, "A", "u", dt.datetime(2024, 1, 1, 12), None, rng.randint(0, 400), n % 3) for n in range(500)]
    hot = spark.createDataFrame(rows, LISTING_SCHEMA)
    cols = ["id", "price", "updated_at", "seq1", "seq2", "prev_price", "prev_updated_at", "rn"]
    got = price_history(hot, split_rows=25).select(*cols)
    assert sorted(map(tuple, got.collect()), key=repr) == lines(hot)
    key = F.struct("updated_at", "seq1", "seq2", "price")
    sizes = [r["count"] for r in cut_ranges(hot, "id", key, 25).groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 50


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "UTC"])
def test_clock_changes_do_not_reorder(spark, zone):
    """Zoneless times around a change of clocks in the session's time zone are compared as they are."""
    rows = []
    for day in (dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 31), dt.datetime(2024, 10, 27), dt.datetime(2024, 11, 3)):
        rows += [(1, "t", 10.0 + n, 1, 30.0, "A", "u", day + dt.timedelta(minutes=15 * n), None, 0, 0) for n in range(20)]
    hot = spark.createDataFrame(rows, LISTING_SCHEMA)
    cols = ["id", "price", "updated_at", "seq1", "seq2", "prev_price", "prev_updated_at", "rn"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for split_rows in (1, 9):
            got = price_history(hot, split_rows=split_rows).select(*cols)
            assert sorted(map(tuple, got.collect()), key=repr) == lines(hot)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ranges_of_keys_with_nulls_and_repeats(spark):
    """Ranges follow the order, equal keys share one, small and null groups aren't cut."""
    rng = random.Random(9)
    rows = [("a", None if n % 11 == 0 else rng.randint(0, 90)) for n in range(400)] + [("b", 1), ("b", 2)] + [(None, n) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, k int")
    out = cut_ranges(df, "g", F.struct("k"), 30)
    got = out.collect()
    assert sorted(((r.g, r.k) for r in got), key=repr) == sorted(rows, key=repr)
    assert {r._range for r in got if r.g != "a"} == {-1}
    by = {}
    for r in got:
        if r.g == "a":
            by.setdefault(-1 if r.k is None else r.k, set()).add(r._range)
    assert all(len(v) == 1 for v in by.values())
    order = [min(by[k]) for k in sorted(by)]
    assert order == sorted(order) and len(set(order)) > 1
    assert {r.g for r in cut_ranges(df, "g", F.struct("k"), 30, large_only=True).collect()} == {"a"}
