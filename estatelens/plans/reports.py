"""The reference's two report jobs as lazy DataFrame plans.

``movers_report``: price moves in an area band -> top k per location ->
listing/location blocks -> report rows (the small-flat and medium-flat jobs
are the same plan with another band and title).

``cheapest_report``: k cheapest per location -> geocoded -> map markers,
centre, per-location stats, top locations, chart series, table rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.fmt import fixed, html_escape, link, whole_money
from estatelens.functions.html import sanitize
from estatelens.operators.longtext import pack_document
from estatelens.operators.textprep import messages
from estatelens.operators.geo import centroid, geocode, markers
from estatelens.operators.report import listing_blocks, location_blocks, report_rows
from estatelens.operators.stats import chart_series, region_stats, top_regions
from estatelens.operators.topk import cheapest, price_movers

# Own display defaults per band (the two twin jobs).
BAND_TITLES = {
    (0.0, 40.0): "Largest price moves per location, flats up to 40 sq m:",
    (40.0, 60.0): "Largest price moves per location, flats of 40 to 60 sq m:",
}


@dataclass
class MoversReport:
    movers: DataFrame
    blocks: DataFrame
    location_blocks: DataFrame
    rows: DataFrame


def movers_report(listings: DataFrame, area_lo: float = 0.0, area_hi: float = 40.0, k: int = 3,
                  match: str = "latest", title: str | None = None) -> MoversReport:
    movers = price_movers(listings, area_lo, area_hi, k=k, match=match)
    blocks = listing_blocks(movers)
    locs = location_blocks(blocks)
    t = title or BAND_TITLES.get((float(area_lo), float(area_hi)),
                                 f"Largest price moves per location, area {area_lo} to {area_hi}:")
    return MoversReport(movers, blocks, locs, report_rows(locs, t))


def report_messages(report_rows_df: DataFrame, report_id: str, header: str, footer: str,
                    max_length: int = 3000) -> DataFrame:
    """S5 + X20 + X24 + X25-X28 for a whole report: each block is sanitised
    (a tag never spans two blocks), the document is packed into chunks exactly
    as one string would be (distributed, see ``longtext``), and the chunks are
    framed as the report's messages."""
    clean = report_rows_df.select("seq", "location", sanitize("text").alias("text"))
    chunks = pack_document(clean, ["seq", "location"], "text", max_length)
    chunks = chunks.withColumn("report_id", F.lit(report_id))
    return messages(chunks, "report_id", header, footer)


def formatted_table(geocoded: DataFrame, currency: str = "AED", area_unit: str = "sq m",
                    link_label: str = "Open") -> DataFrame:
    """X13-X15 + F15: the rows of the listing table."""
    return geocoded.select(
        "id", html_escape(F.coalesce(F.col("location"), F.lit(""))).alias("location"),
        whole_money("price", currency).alias("price_formatted"),
        F.concat(fixed("area", 1), F.lit(" " + area_unit)).alias("area_formatted"),
        "rank", link("url", link_label).alias("link"))


@dataclass
class CheapestReport:
    ranked: DataFrame
    geocoded: DataFrame
    centre: DataFrame
    markers: DataFrame
    stats: DataFrame
    top: DataFrame
    chart: DataFrame
    table: DataFrame


def cheapest_report(listings: DataFrame, area_hi: float = 40.0, k: int = 3, top_n: int = 10,
                    url_base: str = "https://listings.example/property/") -> CheapestReport:
    # Only the displayed lists need the (location, rank) order; markers, the
    # centre and the stats work on the unsorted top-k (no range sort for them).
    top_k = cheapest(listings, area_hi, k, ordered=False)
    order = [F.col("location").asc_nulls_last(), F.col("rank")]
    geo = geocode(top_k, url_base=url_base)
    stats = region_stats(geo)
    top = top_regions(stats, top_n)
    return CheapestReport(top_k.orderBy(*order), geo, centroid(geo), markers(geo), stats, top, chart_series(top),
                          formatted_table(geo.orderBy(*order)))
