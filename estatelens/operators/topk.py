"""Top-k per group.

``row_number() <= k`` is planned as ``WindowGroupLimit`` (partial, before the
shuffle, and final): each map task forwards at most ``k`` rows per group, so a
location holding a third of all rows costs no more network than any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.operators.changes import latest_changes, min_move, plausible, price_changes
from estatelens.operators.filters import area_band, non_blank, positive_price
from estatelens.operators.order import CHEAP_TIEBREAK, MOVER_TIEBREAK


def top_k_per_group(df: DataFrame, keys, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows numbered 1..k within each group of ``keys`` by ``order`` (a total
    order is the caller's duty). A null key is a group of its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def mover_order(tiebreak=MOVER_TIEBREAK) -> list[Column]:
    """Largest move first; ties: the first tie-break column (id) ascending,
    then the newest observation (the rest descending)."""
    first, *rest = tiebreak
    return ([F.col("abs_pct_change").desc_nulls_last(), F.col(first).asc_nulls_last()]
            + [F.col(c).desc_nulls_last() for c in rest])


def price_movers(listings: DataFrame, area_lo: float | None = 0.0, area_hi: float | None = 40.0,
                 k: int = 3, match: str = "latest", min_pct: float = 0.1, max_pct: float = 25.0,
                 method: str = "top2") -> DataFrame:
    """The ``k`` largest plausible moves per non-blank location.
    ``position`` numbers them from 1 in order of decreasing move.

    With ``match="all"`` every observation of an id carries the same move, so
    within a location its rows rank by time alone: only the ``k`` newest
    observations per (id, location) can make the cut, and only those are
    joined (exact; bounded work for a hot id)."""
    pre = ("location", k) if match == "all" else None
    changes = plausible(price_changes(listings, area_lo, area_hi, match, min_pct, method=method,
                                      per_id_group=pre), min_pct, max_pct)
    return top_k_per_group(non_blank(changes), ["location"], mover_order(), k, "position")


def locations(df: DataFrame, col: str = "location") -> DataFrame:
    """A3 + F8 + O4: distinct non-blank locations in code-point order."""
    return non_blank(df.select(col), col).distinct().orderBy(col)


def mover_locations(listings: DataFrame, area_lo: float | None = 0.0, area_hi: float | None = 40.0,
                    match: str = "latest", min_pct: float = 0.1, max_pct: float = 25.0) -> DataFrame:
    """The distinct non-blank locations that appear among the plausible price
    changes (A3 over F7), without materialising the all-mode fan-out: band
    observations are first reduced to distinct ``(id, location)`` pairs (an
    aggregate that combines map-side, so a hot id collapses to a few rows),
    then kept when their id has a plausible move."""
    if match == "latest":
        return locations(plausible(price_changes(listings, area_lo, area_hi, "latest", min_pct), min_pct, max_pct))
    moved = plausible(min_move(latest_changes(listings), min_pct), min_pct, max_pct).select("id")
    pairs = non_blank(area_band(listings, area_lo, area_hi).select("id", "location", "area")).select(
        "id", "location").distinct()
    return pairs.join(moved, "id", "left_semi").select("location").distinct().orderBy("location")


def cheap_order(tiebreak=CHEAP_TIEBREAK) -> list[Column]:
    return [F.col("price").asc_nulls_last()] + [F.col(c).asc_nulls_last() for c in tiebreak]


def cheapest(listings: DataFrame, area_hi: float = 40.0, k: int = 3, area_lo: float | None = None,
             ordered: bool = True) -> DataFrame:
    """W4 + F10 + O3: the ``k`` cheapest listings (price > 0, area <= ``area_hi``)
    of every location, null location included, ordered by location then rank."""
    base = area_band(positive_price(listings), area_lo, area_hi)
    ranked = top_k_per_group(base, ["location"], cheap_order(), k, "rank")
    out = ranked.select("id", "location", "area", "price", "geography", "rank")
    if ordered:
        out = out.orderBy(F.col("location").asc_nulls_last(), F.col("rank"))
    return out
