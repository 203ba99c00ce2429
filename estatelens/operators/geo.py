"""Geocoding, map centre and map markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.exact import exact_avg
from estatelens.functions.fmt import fixed, html_escape, listing_url, whole_money
from estatelens.functions.geo import parse_geography


def geocode(df: DataFrame, col: str = "geography", url_base: str = "https://listings.example/property/",
            keep_unparsed: bool = False) -> DataFrame:
    """Add ``latitude``/``longitude`` parsed from ``col`` and the listing ``url``;
    rows without both coordinates are dropped (F9) unless ``keep_unparsed``.
    Ranks computed before are not renumbered (quirk Q9)."""
    lat, lon = parse_geography(col)
    out = df.withColumns({"latitude": lat, "longitude": lon})
    if not keep_unparsed:
        out = out.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                         & ~F.isnan("latitude") & ~F.isnan("longitude"))
    return out.withColumn("url", listing_url("id", url_base))


def centroid(df: DataFrame) -> DataFrame:
    """A2: one row, mean latitude and longitude (a two-phase aggregate, the same to the last bit under any partitioning)."""
    return df.agg(exact_avg("latitude").alias("center_lat"), exact_avg("longitude").alias("center_lon"))


# Own display defaults for the marker texts.
MARKER_TEXT = {"area": "sq m in", "rank": "No.", "rank_suffix": "by price here", "currency": "AED"}
RANK_COLOURS = ("green", "blue", "red")  # rank 1, rank 2, any other rank


def markers(df: DataFrame, text: dict | None = None) -> DataFrame:
    """E5 + X12: colour, hover label and popup HTML per geocoded listing.
    Location and URL text are HTML-escaped (quirk Q19)."""
    t = dict(MARKER_TEXT, **(text or {}))
    loc = html_escape(F.coalesce(F.col("location"), F.lit("")))
    price = whole_money("price", t["currency"])
    colour = (F.when(F.col("rank") == 1, F.lit(RANK_COLOURS[0]))
              .when(F.col("rank") == 2, F.lit(RANK_COLOURS[1])).otherwise(F.lit(RANK_COLOURS[2])))
    popup = F.concat(
        F.lit('<a href="'), html_escape(F.col("url")), F.lit('" target="_blank">'), price, F.lit("</a><ul><li>"),
        fixed("area", 1), F.lit(f" {t['area']} "), loc, F.lit(f"</li><li>{t['rank']} "), F.col("rank").cast("string"),
        F.lit(f" {t['rank_suffix']}</li></ul>"))
    return df.select("id", "location", "latitude", "longitude", "rank",
                     colour.alias("color"),
                     F.concat(price, F.lit(", "), loc).alias("tooltip"),
                     popup.alias("popup"))
