"""Listings source.

``read_listings`` reads any Spark source (parquet, a JDBC table read in parallel
on a numeric partition column, ...) and conforms it to ``LISTING_SCHEMA`` (``conform``).
``listings_from_testdata`` derives the same table from the driver's TPC-H-style
tables (mapping in FIXTURES.md section 2): one observation per lineitem row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.sources.typed import conform
from estatelens.sources.schema import REQUIRED_FOR_CHANGES
from estatelens.sources.text import read_table

# Fixed values of the test-data mapping (FIXTURES.md section 2).
TESTDATA_URL_BASE = "https://listings.example/property/"
GEO_LAT_LABEL = "Широта: "
GEO_LON_LABEL = "Долгота: "


def read_listings(spark: SparkSession, fmt: str = "parquet", path: str | None = None,
                  options: dict | None = None, required=REQUIRED_FOR_CHANGES) -> DataFrame:
    """Read listings from any source; ``required`` names the columns that must exist. For JDBC pass ``url``, ``dbtable`` and, to
    read in parallel, ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``;
    credentials come only from ``options``."""
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load(path) if path is not None else reader.load()
    return conform(df, required)


def jdbc_options(url: str, table: str, lower_bound: int, upper_bound: int, num_partitions: int,
                 partition_column: str = "id", user: str | None = None,
                 password: str | None = None, fetch_size: int = 10_000, extra: dict | None = None) -> dict:
    """Options for a parallel JDBC read: ``num_partitions`` range queries on
    ``partition_column`` between the bounds (rows outside still land in the
    first/last range). The bounds have no default: without them one task would
    read the whole table. Credentials come only from the caller."""
    if num_partitions < 1 or lower_bound >= upper_bound:
        raise ValueError("a JDBC read needs num_partitions >= 1 and lower_bound < upper_bound")
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "partitionColumn": partition_column,
            "lowerBound": str(lower_bound), "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    opts.update(extra or {})
    return opts


def read_listings_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """S1 over a database table; the filters of the operators (price > 0,
    area band, time present) are pushed into the generated SQL by Spark."""
    return read_listings(spark, "jdbc", options=jdbc_options(url, table, **kwargs))


def land_listings(listings: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Write the listings once as a catalog table bucketed and sorted by
    ``id`` and return it. Windows and joins on ``id`` over the returned table
    read co-partitioned buckets and need no exchange (the latest-change plan then
    has no shuffle at all); ``buckets`` should follow the data size like shuffle
    partitions do. Rows are shuffled by ``id`` first, so each bucket is written by one
    task as one file; an id with many rows makes its bucket's task as long."""
    (listings.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id", "updated_at")
     .mode(mode).saveAsTable(table))
    return listings.sparkSession.table(table)


def _geography(partkey: Column) -> Column:
    def part(base: int, mod: int, mult: int = 1) -> Column:
        whole = (F.lit(base) + partkey % mod).cast("string")
        frac = F.lpad(((partkey * mult) % 1000).cast("string"), 3, "0")
        return F.concat(whole, F.lit("."), frac)

    text = F.concat(F.lit(GEO_LAT_LABEL), part(24, 3), F.lit(", " + GEO_LON_LABEL), part(54, 2, 7))
    return (F.when(partkey % 11 == 0, F.lit(None).cast("string"))
            .when(partkey % 13 == 0, F.lit("25.1"))
            .otherwise(text))


def listings_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem JOIN part`` mapped onto the listings schema.

    The join is an inner equi-join on the part key; with AQE Spark broadcasts
    ``part`` only when its measured size is under the broadcast threshold and
    otherwise sort-merges, splitting skewed part keys."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    pk, ok = F.col("l_partkey"), F.col("l_orderkey")
    size = F.col("p_size").cast("double")
    # Values that the filters, defaults and sanitisers are there for (FIXTURES.md section 2).
    price = (F.when(ok % 101 == 0, F.lit(0.0)).when(ok % 103 == 0, -F.col("l_extendedprice"))
             .when(ok % 107 == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice")))
    area = F.when(pk % 89 == 0, F.lit(0.0)).when(pk % 83 == 0, -size).when(pk % 79 == 0, F.lit(None).cast("double")).otherwise(size)
    location = (F.when(pk % 97 == 0, F.lit(None).cast("string")).when(pk % 53 == 0, F.lit(""))
                .when(pk % 37 == 0, F.concat(F.col("p_brand"), F.lit(' <R> & "D"'))).otherwise(F.col("p_brand")))
    title = (F.when(pk % 71 == 0, F.lit(None).cast("string"))
             .when(pk % 7 == 0, F.concat(F.col("p_name"), F.lit(' <b>new</b> & "best" 5 > 4'))).otherwise(F.col("p_name")))
    return joined.select(
        pk.alias("id"),
        title.alias("title"),
        price.alias("price"),
        F.when(ok % 113 == 0, F.lit(None).cast("int")).otherwise(F.col("l_linenumber")).alias("rooms"),
        area.alias("area"),
        location.alias("location"),
        F.concat(F.lit(TESTDATA_URL_BASE), pk.cast("string"), F.lit("/")).alias("property_url"),
        F.when(ok % 109 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("l_shipdate")).alias("updated_at"),
        _geography(pk).alias("geography"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
    )


def untyped_listings_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listings as other systems deliver them: numbers as texts, decimals or doubles, dates as texts, titles as bytes,
    no geography; some values of each that can't be read or don't fit."""
    ok = F.col("seq1")
    return listings_from_testdata(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        F.when(ok % 23 == 0, F.unhex(F.lit("FF"))).otherwise(F.col("title").cast("binary")).alias("title"),
        F.concat(F.when(ok % 17 == 0, "AED ").otherwise(" "), F.col("price").cast("string"), F.lit(" ")).alias("price"),
        (F.col("rooms") + F.when(ok % 5 == 0, 0.75).otherwise(0.0)).cast("decimal(6,2)").alias("rooms"),
        F.col("area").cast("float").alias("area"), "location", "property_url",
        F.when(ok % 19 == 0, "soon").otherwise(F.col("updated_at").cast("string")).alias("updated_at"),
        ok.cast("double").alias("seq1"),
        F.concat(F.col("seq2").cast("string"), F.when(ok % 3 == 0, ".9").otherwise(".0")).alias("seq2"))
