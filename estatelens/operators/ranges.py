"""Ranges of about equal row counts within the large groups of a table.

Whether a row is in its group's sample is decided by a hash of its sort key, so samples of parts of a table
merge by union, and the sample is the same under any partitioning. Its quantiles cut a group into ranges
that follow each other in the order of the key: values are compared as they are, whatever
their type or the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampled keys a range: its row count strays by about one part in eight.
SAMPLES = 64


def range_bounds(df: DataFrame, group: str, key: Column, rows_per_range: int) -> DataFrame:
    """``(group, bounds)``: the keys that ranges start with, in order, of the groups with more than about ``rows_per_range`` rows.

    Exactly equal keys count once and are never parted. There is about one bound for every ``rows_per_range`` rows
    of the table, and the sample that is sorted a group is a ``SAMPLES``-th of that distance apart."""
    step = max(1, rows_per_range // SAMPLES)
    sampled = df.select(F.col(group), key.alias("_place")).filter(F.pmod(F.xxhash64(group, "_place"), F.lit(step)) == 0).distinct()
    at = F.row_number().over(Window.partitionBy(group).orderBy("_place"))
    return (sampled.withColumn("_at", at).filter(F.col("_at") % max(1, rows_per_range // step) == 0)
            .groupBy(group).agg(F.array_sort(F.collect_list("_place")).alias("bounds")))


def range_number(bounds: Column, key: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by halving."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.floor((low + high) / 2).cast("int")
        right = F.get(bounds, middle) <= key
        return F.when(low >= high, span).otherwise(F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right, high).otherwise(middle).alias("high")))
    return F.aggregate(rounds, start, halve, lambda span: span["low"])


def cut_ranges(df: DataFrame, group: str, key: Column, rows_per_range: int, name: str = "_range", large_only: bool = False,
               bounds: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``: the number of the row's range in its group from 0, and -1 throughout a group that isn't cut.

    ``key`` is what ranges follow, ascending with nulls first; equal keys share a range. With ``large_only``, rows
    of groups that aren't cut are left out. A null group is never cut. ``df`` is scanned once more for the
    sample, with the columns of ``key`` only. The table of bounds has about a row for every
    ``rows_per_range`` rows, which is why it is broadcast where that is large; ``bounds`` gives one made before."""
    bounds = (range_bounds(df, group, key, rows_per_range) if bounds is None else bounds).withColumnRenamed("bounds", "_bounds")
    if rows_per_range >= 1_000_000:
        bounds = F.broadcast(bounds)
    joined = df.join(bounds, group, "inner" if large_only else "left")
    return joined.withColumn(name, F.when(F.col("_bounds").isNull(), -1).otherwise(range_number(F.col("_bounds"), key))).drop("_bounds")
