"""Row filters (F1-F4, F8) and the most-recent-N scan (O2).

All are plain predicates, so Catalyst pushes them into the Parquet/JDBC scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.operators.order import TIME_TIEBREAK


def positive_price(df: DataFrame, col: str = "price") -> DataFrame:
    """``price > 0``; null prices are dropped."""
    return df.filter(F.col(col) > 0)


def with_timestamp(df: DataFrame, col: str = "updated_at") -> DataFrame:
    """rows that have an observation time."""
    return df.filter(F.col(col).isNotNull())


def area_predicate(lo: float | None, hi: float | None, col: str = "area") -> Column:
    """(lo, hi]: open below, closed above. ``lo=None`` is a ceiling only."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c > F.lit(float(lo)))
    if hi is not None:
        cond = cond & (c <= F.lit(float(hi)))
    return cond


def area_band(df: DataFrame, lo: float | None, hi: float | None, col: str = "area") -> DataFrame:
    """keep rows whose area lies in (lo, hi]; a null area never passes."""
    return df.filter(area_predicate(lo, hi, col) & F.col(col).isNotNull())


def non_blank(df: DataFrame, col: str = "location") -> DataFrame:
    """F8: drop null or empty group keys."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def most_recent(df: DataFrame, n: int = 1000, time_col: str = "updated_at",
                tiebreak=TIME_TIEBREAK + ("id",), method: str = "heap") -> DataFrame:
    """O2: the ``n`` newest rows. Null times sort first, as a descending sort
    does in the reference's database. Planned as ``TakeOrderedAndProject``: each
    task keeps its own top ``n`` and only those reach the final merge.

    ``method="threshold"`` first counts rows by day, which reads ``time_col`` and the filters' columns only, and then
    reads the rows from the day on that the ``n``-th newest falls in: a predicate that reaches the scan, so files and
    row groups of older days are skipped where the table is in any order of time (Spark 4.1 does so for
    ``timestamp``, not yet for ``timestamp_ntz``). The rows are the same, ties included, since a
    whole day is kept."""
    if method == "threshold":
        day = newest_day(df, n, time_col)
        if day is not None:
            times = df.schema[time_col].dataType
            since = F.col(time_col).isNull()
            df = df.filter(since if day == "" else since | (F.col(time_col) >= F.lit(day).cast(times)))
    elif method != "heap":
        raise ValueError(f"unknown method {method!r}")
    order = [F.col(time_col).desc_nulls_first()] + [F.col(c).desc_nulls_last() for c in tiebreak]
    return df.orderBy(*order).limit(n)


def newest_day(df: DataFrame, n: int, time_col: str = "updated_at") -> str | None:
    """The day from which on there are at least ``n`` rows, as text; "" if rows without a time are enough, None if all rows are
    fewer. One row comes to the driver; the counts that are summed are as many as there are days."""
    days = df.groupBy(F.col(time_col).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.col("day").desc_nulls_first())
    reached = days.withColumn("sum", F.sum("n").over(newer)).filter(F.col("sum") >= n).orderBy(F.col("day").desc_nulls_first()).first()
    if reached is None:
        return None
    return "" if reached.day is None else reached.day.isoformat()
