"""Declared schema of the listings table and the required-column probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One row is one observation of a listing; several rows share an ``id``.
# ``seq1``/``seq2`` are not listing attributes: they only make the time order total.
LISTING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("rooms", T.IntegerType(), True),
    T.StructField("area", T.DoubleType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("property_url", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("geography", T.StringType(), True),
    T.StructField("seq1", T.LongType(), True),
    T.StructField("seq2", T.IntegerType(), True),
])

LISTING_COLUMNS = [f.name for f in LISTING_SCHEMA.fields]
ATTRIBUTE_COLUMNS = ["title", "price", "rooms", "area", "location", "property_url"]
REQUIRED_FOR_CHANGES = ["updated_at", "id", "price"]


def missing_columns(df: DataFrame, required=REQUIRED_FOR_CHANGES) -> list[str]:
    """Names in ``required`` that ``df`` lacks, in the order given (case-sensitive)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required=REQUIRED_FOR_CHANGES) -> DataFrame:
    """Fail early, naming the columns, instead of falling back to other data."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"listings table lacks required columns: {', '.join(missing)}")
    return df
