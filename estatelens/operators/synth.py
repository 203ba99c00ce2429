"""Synthetic moves and the fallback source (G1-G3, quirk Q4).

Never applied silently: every row says in ``is_synthetic`` whether it is made up.
Draws are hashes of the row's own key and a seed, so they are the same under any
partitioning and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns that a draw depends on; they identify an observation.
DRAW_KEY = ("id", "updated_at", "seq1", "seq2")


def uniform(lo: float, hi: float, seed: int, stream: int, key=DRAW_KEY) -> Column:
    """A draw from ``[lo, hi)``: 52 bits of the MD5 of seed, stream and row key."""
    parts = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "updated_at" else F.col(c).cast("string") for c in key]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(stream)), *[F.coalesce(p, F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(2 ** 52)) * F.lit(hi - lo) + F.lit(lo)


def _with_move(df: DataFrame, pct: Column) -> DataFrame:
    return (df.withColumn("pct_change", pct)
            .withColumn("absolute_change", F.col("price") * F.col("pct_change") / F.lit(100))
            .withColumn("prev_price", F.col("price") - F.col("absolute_change"))
            .withColumn("is_synthetic", F.lit(True)))


def synthesize_moves(df: DataFrame, seed: int = 7, lo: float = -5.0, hi: float = 8.0, key=DRAW_KEY) -> DataFrame:
    """G1: ``pct ~ U(lo, hi)``, ``absolute = price * pct / 100``, ``prev = price - absolute``."""
    return _with_move(df, uniform(lo, hi, seed, 0, key))


def synthesize_moves_deadzone(df: DataFrame, seed: int = 7, lo: float = -5.0, hi: float = 8.0,
                              dead: float = 0.1, key=DRAW_KEY) -> DataFrame:
    """A draw inside ``[-dead, dead]`` is redrawn, with even odds, as
    ``-U(dead, -lo)`` or ``U(dead, hi)``."""
    first = uniform(lo, hi, seed, 0, key)
    redraw = F.when(uniform(0.0, 1.0, seed, 1, key) < 0.5, -uniform(dead, -lo, seed, 2, key)).otherwise(
        uniform(dead, hi, seed, 3, key))
    return _with_move(df, F.when(first.between(-dead, dead), redraw).otherwise(first))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows of ``primary`` or, where it has none, those of ``fallback``, as one lazy plan.

    ``is_synthetic`` tells them apart; columns that ``fallback`` lacks are null there. Whether
    ``primary`` is empty is a one-row table that ``fallback`` is anti-joined with. That table is
    made from all of the primary's columns, so the primary's shuffle is reused."""
    names = [c for c in primary.columns if c != "is_synthetic"]
    types = dict(primary.dtypes)
    real = primary.select(*names, F.lit(False).alias("is_synthetic"))
    made = fallback.select(*[(F.col(c) if c in fallback.columns else F.lit(None)).cast(types[c]).alias(c) for c in names],
                           F.lit(True).alias("is_synthetic"))
    found = primary.limit(1).select((F.xxhash64(*names) * F.lit(0)).alias("_found"))
    made = made.withColumn("_found", F.lit(0).cast("long")).join(F.broadcast(found), "_found", "left_anti").drop("_found")
    return real.unionByName(made)
