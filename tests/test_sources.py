"""Listings source: any format, conformed to the declared schema."""

import tempfile

import pytest
from pyspark.sql import functions as F

from estatelens.sources import LISTING_SCHEMA, listings_from_testdata, read_listings
from tests.conftest import SF_SMALL


def test_read_listings_roundtrip(spark):
    L = listings_from_testdata(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="estatelens-src-") + "/listings"
    # a source with other types and without the tie-break columns
    L.select(F.col("id").cast("int").alias("id"), "title", F.col("price").cast("decimal(18,2)").alias("price"),
             "rooms", "area", "location", "property_url", "updated_at", "geography").write.parquet(path)
    got = read_listings(spark, "parquet", path)
    assert got.schema == LISTING_SCHEMA or [f.dataType for f in got.schema] == [f.dataType for f in LISTING_SCHEMA]
    assert got.count() == L.count()
    assert got.filter(F.col("seq1").isNotNull()).count() == 0


def test_read_listings_needs_id(spark):
    path = tempfile.mkdtemp(prefix="estatelens-src-") + "/bad"
    spark.createDataFrame([(1.0,)], "price double").write.parquet(path)
    with pytest.raises(ValueError, match="id"):
        read_listings(spark, "parquet", path)


def test_missing_required_columns_are_named(spark):
    L = listings_from_testdata(spark, SF_SMALL)
    from estatelens.operators import changes as ch
    for column in ("price", "updated_at"):
        path = tempfile.mkdtemp(prefix="estatelens-src-") + "/short"
        L.drop(column).limit(5).write.parquet(path)
        with pytest.raises(ValueError, match=column):
            read_listings(spark, "parquet", path)
        with pytest.raises(ValueError, match=column):
            ch.price_history(L.drop(column))


def test_values_that_do_not_fit_become_null(spark):
    path = tempfile.mkdtemp(prefix="estatelens-src-") + "/dirty"
    spark.createDataFrame([(1, "Studio", "not a date", "1e30", "x"), (2, "2", "2024-03-05 10:00:00", "100.5", "30")],
                          "id long, rooms string, updated_at string, price string, area string").write.parquet(path)
    bad, good = read_listings(spark, "parquet", path).orderBy("id").collect()
    assert (bad.rooms, bad.updated_at, bad.price, bad.area) == (None, None, 1e30, None)
    assert (good.rooms, str(good.updated_at), good.price, good.area) == (2, "2024-03-05 10:00:00", 100.5, 30.0)


def test_formatting_survives_nan_and_huge_numbers(spark):
    from estatelens.functions.fmt import int_or_zero, whole_money
    from estatelens.operators.geo import markers
    rows = spark.createDataFrame([(float("nan"),), (1e30,), (1999.9,), (None,)], "v double")
    got = [(r[0], r[1]) for r in rows.select(whole_money("v"), int_or_zero("v")).collect()]
    assert got == [("0 AED", 0), ("0 AED", 0), ("1,999 AED", 1999), (None, 0)]
    one = spark.createDataFrame([(1, "A", 25.0, 55.0, float("nan"), 30.0, 1, "u")],
                                "id long, location string, latitude double, longitude double, price double, area double, rank int, url string")
    assert "0 AED" in markers(one).first().popup


def test_jdbc_options():
    from estatelens.sources import jdbc_options
    o = jdbc_options("jdbc:postgresql://db/x", "listings", 1, 1_000_000, 64, user="u", password="p")
    assert o == {"url": "jdbc:postgresql://db/x", "dbtable": "listings", "fetchsize": "10000",
                 "partitionColumn": "id", "lowerBound": "1", "upperBound": "1000000", "numPartitions": "64",
                 "user": "u", "password": "p"}
    with pytest.raises(TypeError):
        jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", 5, 5, 8)


def test_landed_listings_need_no_shuffle(spark):
    """A table bucketed by id: the id windows read co-partitioned data."""
    from estatelens.operators import changes as ch
    from estatelens.sources import land_listings
    L = listings_from_testdata(spark, SF_SMALL)
    T = land_listings(L, "listings_landed_test", 4)
    df = ch.latest_changes(T)
    df.write.format("noop").mode("overwrite").save()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, ch.latest_changes(L).collect()))
    assert len(T.inputFiles()) <= 4
