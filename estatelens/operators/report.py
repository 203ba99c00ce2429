"""Report text as rows.

A listing block is one row, a location block one row (its <= k listing blocks
in position order), the title one row. Nothing is concatenated across
locations here: the whole document exists only at the sink, as ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.fmt import date_text, int_or_zero, money, signed_pct, fixed, zero_if_null

# Own display defaults.
REPORT_TEXT = {
    "title": "Largest price moves per location, flats up to 40 sq m:",
    "location": "== ",
    "rule": "=" * 12,
    "number": "#",
    "id": "- listing ",
    "price": "- now ",
    "prev_price": "- was ",
    "change": "- moved ",
    "last_update": "- seen ",
    "prev_update": "- before that ",
    "area": "- size ",
    "area_unit": " sq m",
    "rooms": "- rooms ",
    "link": "- see ",
    "currency": " AED",
    "up": "▲",
    "down": "▼",
}


def formatted_moves(movers: DataFrame, text: dict | None = None) -> DataFrame:
    """The printable fields of each mover."""
    t = dict(REPORT_TEXT, **(text or {}))
    # the date lines need both columns to exist (a driver-side schema
    # check) and both values to be present (a row-level condition).
    for c in ("current_updated_at", "prev_updated_at"):
        if c not in movers.columns:
            movers = movers.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    both_dates = F.col("current_updated_at").isNotNull() & F.col("prev_updated_at").isNotNull()
    return movers.select(
        "location", "position", "id",
        F.coalesce(F.col("title"), F.lit("")).alias("title_text"),
        money("price").alias("price_text"),
        money("prev_price").alias("prev_price_text"),
        signed_pct("pct_change", t["up"], t["down"]).alias("change_text"),
        F.when(both_dates, date_text("current_updated_at")).alias("current_date_text"),
        F.when(both_dates, date_text("prev_updated_at")).alias("prev_date_text"),
        fixed(zero_if_null("area"), 2).alias("area_text"),
        int_or_zero("rooms").alias("rooms_value"),
        F.coalesce(F.col("property_url"), F.lit("")).alias("url_text"),
    )


def listing_blocks(movers: DataFrame, text: dict | None = None) -> DataFrame:
    """One numbered block per mover; the two date lines only when both
    dates exist (F14). Ends with an empty line, i.e. a trailing newline."""
    t = dict(REPORT_TEXT, **(text or {}))
    f = formatted_moves(movers, t)
    dates = F.when(F.col("current_date_text").isNotNull(), F.concat(
        F.lit("\n" + t["last_update"]), F.col("current_date_text"),
        F.lit("\n" + t["prev_update"]), F.col("prev_date_text"))).otherwise(F.lit(""))
    lines = [
        F.concat(F.lit(t["number"]), F.col("position").cast("string"), F.lit(" "), F.col("title_text")),
        F.concat(F.lit(t["id"]), F.col("id").cast("string")),
        F.concat(F.lit(t["price"]), F.col("price_text"), F.lit(t["currency"])),
        F.concat(F.lit(t["prev_price"]), F.col("prev_price_text"), F.lit(t["currency"])),
        F.concat(F.lit(t["change"]), F.col("change_text"), dates),
        F.concat(F.lit(t["area"]), F.col("area_text"), F.lit(t["area_unit"])),
        F.concat(F.lit(t["rooms"]), F.col("rooms_value").cast("string")),
        F.concat(F.lit(t["link"]), F.col("url_text")),
        F.lit(""),
    ]
    return f.select("location", "position", "id", F.concat_ws("\n", *lines).alias("block"))


def location_blocks(blocks: DataFrame, text: dict | None = None) -> DataFrame:
    """X7 + A5: header, rule, the listing blocks in position order, blank line.
    Each group holds at most k rows (the top-k cut upstream)."""
    t = dict(REPORT_TEXT, **(text or {}))
    ordered = F.array_sort(F.collect_list(F.struct("position", "block")))
    return (blocks.groupBy("location")
            .agg(ordered.alias("_b"), F.count("*").alias("n_listings"))
            .select("location", "n_listings",
                    F.concat(F.lit(t["location"]), F.col("location"), F.lit("\n" + t["rule"] + "\n"),
                             F.array_join(F.transform("_b", lambda b: b["block"]), "\n"),
                             F.lit("\n")).alias("block")))


def report_rows(loc_blocks: DataFrame, title: str | None = None, keep_title: bool = True) -> DataFrame:
    """The document as ordered rows ``(seq, location, text)``: the title row
    (``seq`` 0), then one row per location (``seq`` 1) ordered by location.
    Joined with newlines these rows are the whole report."""
    t = REPORT_TEXT["title"] if title is None else title
    body = loc_blocks.select(F.lit(1).alias("seq"), "location", F.col("block").alias("text"))
    if not keep_title:
        return body
    # The empty prefix of a block keeps the title's branch on the same columns as the body's, so
    # Spark reuses the shuffled listing blocks instead of running the pipeline for the title again.
    head = loc_blocks.limit(1).select(F.lit(0).alias("seq"), F.lit(None).cast("string").alias("location"),
                                      F.concat(F.lit(t + "\n"), F.substring("block", 1, 0), F.substring("location", 1, 0)).alias("text"))
    return head.unionByName(body)
