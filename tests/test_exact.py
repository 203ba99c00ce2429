"""Means that don't depend on the order of summing."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.functions.exact import exact_avg
from estatelens.operators.stats import region_stats


def means(spark, values, partitions=(1, 3, 7)):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return {df.repartition(n).agg(exact_avg("v")).first()[0] for n in partitions}


@pytest.mark.parametrize("low, high, n", [(1, 1e6, 4000), (-1e6, 1e6, 4000), (-1, 1, 500), (1e12, 1e15, 500), (25.0, 25.1, 3000)])
def test_the_same_bits_under_any_partitioning(spark, low, high, n):
    rng = random.Random(n)
    values = [rng.uniform(low, high) for _ in range(n)]
    got = means(spark, values)
    exact = sum(map(Fraction, values)) / n
    assert len(got) == 1
    mean = got.pop()
    assert abs(Fraction(mean) - exact) <= 2 * Fraction(math.ulp(float(exact)))


def test_what_cancels_is_not_lost(spark):
    assert means(spark, [1e15, 0.1, -1e15, 0.2]) == {float((Fraction(0.1) + Fraction(0.2)) / 4)}
    assert means(spark, [-0.25, -0.75, None]) == {-0.5}
    assert means(spark, [0.1] * 10) == {0.1}


def test_carries_between_limbs(spark):
    """Sums of limbs next to a whole limb carry exactly."""
    top = 1 - 2.0 ** -32
    for values in ([top] * 3, [top, 2.0 ** -32], [-top] * 5, [top] * 2**12 + [2.0 ** -32] * 2**12, [1 - 2.0 ** -53, 2.0 ** -53]):
        assert means(spark, values) == {float(sum(map(Fraction, values)) / len(values))}


def test_nulls_nan_and_huge_numbers(spark):
    assert means(spark, [None, None]) == {None} and means(spark, [None, 3.0]) == {3.0}
    assert all(math.isnan(m) for m in means(spark, [1.0, float("nan")]))
    assert means(spark, [1e300, 3e300], (1,)) == {2e300} and means(spark, [float("inf"), 1.0], (1,)) == {math.inf}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12, allow_subnormal=False).filter(lambda x: x == 0 or abs(x) > 1e-3), min_size=1, max_size=30))
def test_any_values(spark, values):
    mean = means(spark, values, (2,)).pop()
    exact = sum(map(Fraction, values)) / len(values)
    assert abs(Fraction(mean) - exact) <= 3 * Fraction(math.ulp(float(exact))) + Fraction(2) ** -60


def test_region_stats_are_the_same_bits(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("AB"), rng.uniform(1e3, 1e7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, location string, price double")
    got = {tuple(sorted(tuple(r) for r in region_stats(df.repartition(n).sortWithinPartitions("price" if n % 2 else "id")).collect())) for n in (1, 2, 5, 8)}
    assert len(got) == 1
