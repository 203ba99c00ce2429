"""Means of doubles that don't depend on the order of summing (A1, A2).

A double is a whole number of 2^-64 wherever its size is at least 2^-11 (smaller ones are read to 2^-64). It is
split into a whole part and two limbs of 32 bits; limbs are added as integers, which gives the same sums in any
order and under any partitioning, and only the three sums are rounded to a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 1 << 32
# Sizes from which a value has no limbs; then, and for NaN, the mean is the ordinary one.
LARGE = float(1 << 62)


def _limbs(x: Column) -> list[Column]:
    """Whole part and limbs of ``x`` toward zero; every step is exact."""
    whole = x.cast("bigint")
    first = (x - whole.cast("double")) * F.lit(float(LIMB))
    second = (first - first.cast("bigint").cast("double")) * F.lit(float(LIMB))
    return [whole, first.cast("bigint"), second.cast("bigint")]


def exact_avg(c) -> Column:
    """The mean as an aggregate expression; nulls don't count, no value gives null.

    The sum of the limbs is exact; turning it into a double and dividing round three times. With a NaN or a value from
    ``LARGE`` on it is Spark's own mean. The sums are ordinary partial aggregates."""
    c = F.col(c) if isinstance(c, str) else c
    small = F.abs(c) < F.lit(LARGE)  # false for NaN, which is above every number
    a, b, d = (F.sum(F.when(small, limb).cast("decimal(28,0)")) for limb in _limbs(F.when(small, c)))
    base = F.lit(LIMB).cast("decimal(10,0)")

    def carried(upper: Column, lower: Column) -> tuple[Column, Column]:
        rest = lower % base  # has the sign of the sum, so what is taken off divides without rest
        return upper + ((lower - rest) / base).cast("decimal(28,0)"), rest

    b, d = carried(b, d)
    a, b = carried(a, b)
    total = a.cast("double") + (b.cast("double") + d.cast("double") / F.lit(float(LIMB))) / F.lit(float(LIMB))
    return F.when(F.count_if(~small) > 0, F.avg(c)).otherwise(total / F.count(c))
