"""Price history and price changes.

Given a total order, the previous observation of a listing is the next one in a
window that runs from the newest to the oldest, and so is the recency number: one
descending window, one sort.

The full history cuts a listing with very many observations into ranges of about equal row
counts, so that no task sorts a whole hot id: windows run within (id, range), and the count
and newest row of each range, a few rows per hot id, link the ranges.

``latest_changes`` needs only the two newest observations of each id. Filtering
``row_number <= 2`` lets Catalyst plan a partial ``WindowGroupLimit`` *before* the
shuffle, so a hot id (even one holding a third of all rows) sends at most two
rows per map task across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.operators.filters import area_predicate, positive_price, with_timestamp
from estatelens.operators.order import TIME_TIEBREAK
from estatelens.operators.ranges import cut_ranges
from estatelens.sources.schema import ATTRIBUTE_COLUMNS, require_columns

CHANGE_COLUMNS = ["current_updated_at", "prev_updated_at", "prev_price", "pct_change", "absolute_change"]
OBSERVATION_COLUMNS = ["id"] + ATTRIBUTE_COLUMNS + ["updated_at", "seq1", "seq2"]


def newest_first(key: str = "id", time_col: str = "updated_at", tiebreak=TIME_TIEBREAK):
    """Window over one listing's observations, newest first, total order."""
    order = [F.col(time_col).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in tiebreak]
    return Window.partitionBy(key).orderBy(*order)


def pct_change(current: Column, prev: Column) -> Column:
    """Percent change; null when there is no previous price or it is 0
    (no division error under ANSI mode: the branch is not evaluated)."""
    return F.when(prev.isNotNull() & (prev != 0), (current - prev) / prev * F.lit(100))


def absolute_change(current: Column, prev: Column) -> Column:
    """Signed difference, null without a previous price."""
    return F.when(prev.isNotNull(), current - prev)


# Observations of one id that one task sorts, about; an id with more is cut into ranges.
SPLIT_ROWS = 2_000_000


def _lined_up(valid: DataFrame, keep, tiebreak=TIME_TIEBREAK, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``id`` and ``keep`` of ``valid`` with ``prev_price``, ``prev_updated_at`` and ``rn``.

    Ids with more than about ``split_rows`` observations are cut into ranges of about so many rows by
    quantiles of the whole order, so neither a crowded day nor a shared second makes one large. The tables
    of bounds and of ranges have a row for every ``split_rows`` observations; that is what makes
    it safe to broadcast them."""
    hint = F.broadcast if split_rows >= 1_000_000 else (lambda df: df)
    key = F.struct("updated_at", *tiebreak, *([] if "price" in tiebreak else ["price"]))
    cut = cut_ranges(valid, "id", key, split_rows)
    order = [F.col("updated_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tiebreak]]
    w = Window.partitionBy("id", "_range").orderBy(*order)
    inside = cut.select("id", "_range", *keep, F.lead("price").over(w).alias("_prev_price"),
                        F.lead("updated_at").over(w).alias("_prev_time"), F.row_number().over(w).alias("_rn"),
                        F.lead(F.lit(1)).over(w).isNull().alias("_oldest"))
    ranges = cut_ranges(valid, "id", key, split_rows, large_only=True).groupBy("id", "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(key).alias("_newest"))
    newer = Window.partitionBy("id").orderBy(F.col("_range").desc())
    links = ranges.select("id", "_range", F.coalesce(F.sum("_rows").over(newer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                          F.lead("_newest").over(newer).alias("_next"))
    out = inside.join(hint(links), ["id", "_range"], "left")
    return out.select("id", *[c for c in keep if c != "id"],
                      F.when(F.col("_oldest"), F.col("_next.price")).otherwise(F.col("_prev_price")).alias("prev_price"),
                      F.when(F.col("_oldest"), F.col("_next.updated_at")).otherwise(F.col("_prev_time")).alias("prev_updated_at"),
                      (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("int").alias("rn"))


def price_history(listings: DataFrame, tiebreak=TIME_TIEBREAK, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """W1-W3 over every valid observation (price > 0, time present):
    previous price/time of the same listing and the recency number ``rn``."""
    valid = with_timestamp(positive_price(require_columns(listings)))
    keep = ["price", "updated_at", *[c for c in tiebreak if c != "price"]]
    return _lined_up(valid, keep, tiebreak, split_rows)


def latest_changes(listings: DataFrame, tiebreak=TIME_TIEBREAK, carry=(),
                   method: str = "top2") -> DataFrame:
    """F5 + E1/E2: one row per listing whose newest valid observation has a
    predecessor. ``carry`` names columns of the newest observation to keep.

    ``method="top2"`` cuts each id to its two newest rows before the shuffle
    (default); ``method="window"`` numbers the whole history."""
    valid = with_timestamp(positive_price(require_columns(listings)))
    keep = list(dict.fromkeys(["price", "updated_at", *carry]))
    if method == "top2":
        w = newest_first(tiebreak=tiebreak)
        two = valid.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
        ranked = two.select("id", *keep, "rn", F.lead("price").over(w).alias("prev_price"),
                            F.lead("updated_at").over(w).alias("prev_updated_at"))
    elif method == "window":
        ranked = _lined_up(valid, keep, tiebreak)
    else:
        raise ValueError(f"unknown method {method!r}")
    cur, prev = F.col("price"), F.col("prev_price")
    out = (ranked.filter((F.col("rn") == 1) & prev.isNotNull())
           .withColumns({
               "current_price": cur,
               "current_updated_at": F.col("updated_at"),
               "pct_change": pct_change(cur, prev),
               "absolute_change": absolute_change(cur, prev),
           }))
    base = ["id", "current_price", "prev_price", "current_updated_at", "prev_updated_at",
            "pct_change", "absolute_change"]
    return out.select(*base, *[c for c in carry if c not in base])


def min_move(df: DataFrame, min_pct: float = 0.1, col: str = "pct_change") -> DataFrame:
    """a real move: ``|pct| > min_pct`` (null fails)."""
    return df.filter(F.col(col).isNotNull() & (F.abs(F.col(col)) > F.lit(float(min_pct))))


def price_changes(listings: DataFrame, area_lo: float | None = 0.0, area_hi: float | None = 40.0,
                  match: str = "latest", min_pct: float = 0.1, tiebreak=TIME_TIEBREAK,
                  method: str = "top2", per_id_group: tuple[str, int] | None = None) -> DataFrame:
    """Newest price change per listing with listing attributes, area band and
    minimum move applied (J1, F3, F6).

    ``match="all"`` reproduces the reference's self-join: the change is joined to
    *every* observation of its id that lies in the area band (quirk Q1), so a
    listing appears once per observation. The change side has one row per id. It
    is keyed by an expression of the id, so that Spark doesn't take it as already
    partitioned: both sides of the join are then plain shuffles, which lets AQE
    broadcast the change side when it is small and split a hot id's observations
    over several tasks when it isn't.

    ``match="latest"`` keeps only the newest observation: attributes ride
    through the window, no join at all.

    ``per_id_group=(col, k)`` (``match="all"`` only) keeps, per id and value of
    ``col``, just the ``k`` newest observations before the join; a caller
    that ranks rows of one id by time within ``col`` (top-k movers per
    location) loses nothing, and a hot id is cut to ``k`` rows per map task."""
    if match == "all":
        changes = min_move(latest_changes(listings, tiebreak, method=method), min_pct)
        obs = listings.filter(area_predicate(area_lo, area_hi)).select(*OBSERVATION_COLUMNS)
        if per_id_group is not None:
            col, k = per_id_group
            w = Window.partitionBy("id", col).orderBy(
                *[F.col(c).desc_nulls_last() for c in ("updated_at", *tiebreak)])
            obs = (obs.filter(F.col(col).isNotNull() & (F.col(col) != ""))
                   .withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k"))
        changes = changes.select(F.col("id").bitwiseXOR(F.lit(0).cast("long")).alias("_changed"), *CHANGE_COLUMNS)
        joined = obs.join(changes, F.col("id") == F.col("_changed"))
    elif match == "latest":
        carry = ATTRIBUTE_COLUMNS + ["seq1", "seq2"]
        changes = latest_changes(listings, tiebreak, carry=carry, method=method)
        joined = (min_move(changes, min_pct)
                  .filter(area_predicate(area_lo, area_hi))
                  .withColumn("updated_at", F.col("current_updated_at")))
    else:
        raise ValueError(f"match must be 'all' or 'latest', not {match!r}")
    return joined.select(*OBSERVATION_COLUMNS, *CHANGE_COLUMNS)


def plausible(df: DataFrame, lo: float = 0.1, hi: float = 25.0, col: str = "pct_change") -> DataFrame:
    """E3 + F7: ``abs_pct_change`` and the band ``lo < |pct| <= hi``. The upper
    bound also drops NaN (Spark orders NaN above every number)."""
    a = F.abs(F.col(col))
    return df.withColumn("abs_pct_change", a).filter((F.col("abs_pct_change") > F.lit(float(lo)))
                                                     & (F.col("abs_pct_change") <= F.lit(float(hi))))
