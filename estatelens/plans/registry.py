"""Named queries (``queries()``) and their DuckDB oracles (``oracle_sql()``).

Each query takes ``(spark, sf_dir)``, reads the fixture tables whole and
returns a DataFrame; all but ``report_messages`` (whose packer runs in passes) are
lazy. Column names match the oracle's exactly."""

from __future__ import annotations

from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.operators import changes as ch
from estatelens.operators import filters as flt
from estatelens.operators import report as rpt
from estatelens.operators import stats as st
from estatelens.operators import synth
from estatelens.operators import textprep as tp
from estatelens.functions.html import sanitize
from estatelens.operators.geo import centroid, geocode, markers
from estatelens.operators.longtext import pack_documents
from estatelens.operators.topk import cheapest, mover_locations, price_movers
from estatelens.plans import oracle as O
from estatelens.plans.reports import formatted_table, report_messages
from estatelens.sources import conform, conform_losses, listings_from_testdata, read_documents, read_pages, untyped_listings_from_testdata

SMALL = (0.0, 40.0)
MEDIUM = (40.0, 60.0)
# Fixed run time for message headers, so outputs are reproducible.
AS_OF = datetime(2024, 1, 15, 9, 30)

Query = Callable[[SparkSession, str], DataFrame]


def _listings(spark, sf):
    return listings_from_testdata(spark, sf)


def _movers(match, band):
    def q(spark, sf):
        return price_movers(_listings(spark, sf), band[0], band[1], k=3, match=match)
    return q


def _changes(match, band):
    def q(spark, sf):
        return ch.price_changes(_listings(spark, sf), band[0], band[1], match=match)
    return q


def _geocoded(spark, sf):
    return geocode(cheapest(_listings(spark, sf), 40.0, 3, ordered=False))


def _doc_messages(spark, sf):
    clean = tp.sanitize_table(read_documents(spark, sf), "text", "text")
    chunks = tp.explode_chunks(clean, "doc_id", "text", 3000)
    return tp.messages(chunks, "doc_id", tp.message_header(AS_OF), tp.message_footer())


def _unbroken_documents(spark, sf):
    """Every document whole; of three, two without white space (nothing to cut at, so chunks are runs of any length
    and messages go over the limit), one as it is, cut at lines, sentences and words."""
    joined = F.regexp_replace("text", r"[ \n\r\t]+", "")
    text = F.when((F.col("doc_id") % 3).isin(0, 1), joined).otherwise(F.col("text"))
    return read_documents(spark, sf).select("doc_id", text.alias("text"))


def _unbroken_messages(spark, sf):
    chunks = tp.explode_chunks(_unbroken_documents(spark, sf), "doc_id", "text", 3000)
    return tp.messages(chunks, "doc_id", tp.message_header(AS_OF), tp.message_footer())


def _page_messages(spark, sf):
    pages = tp.sanitize_table(read_pages(spark, sf), "html", "text")
    chunks = tp.explode_chunks(pages, "page_id", "text", 3000)
    return tp.messages(chunks, "page_id", tp.message_header(AS_OF), tp.message_footer())


def _host_chunks(units_per_segment):
    """All sanitised pages of a host as one document, in page order."""
    def q(spark, sf):
        pages = read_pages(spark, sf).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), sanitize("html").alias("text"))
        return pack_documents(pages, "host", ["page_id"], "text", 3000, units_per_segment)
    return q


def _formatted_movers(spark, sf):
    mv = price_movers(_listings(spark, sf), *SMALL, k=3, match="latest")
    return rpt.formatted_moves(mv)


def _listing_blocks(spark, sf):
    mv = price_movers(_listings(spark, sf), *SMALL, k=3, match="latest")
    return rpt.listing_blocks(mv)


def _location_blocks(spark, sf):
    return rpt.location_blocks(_listing_blocks(spark, sf))


def _report_rows(spark, sf):
    return rpt.report_rows(_location_blocks(spark, sf))


def _report_messages(spark, sf):
    return report_messages(_report_rows(spark, sf), "movers_small_latest", tp.message_header(AS_OF),
                           tp.message_footer())


def _chart(spark, sf):
    top = st.top_regions(st.region_stats(_geocoded(spark, sf)), 10)
    s = st.chart_series(top)
    return s.select(F.to_json("labels").alias("labels_json"), F.to_json("prices").alias("prices_json"),
                    F.size("labels").alias("n_locations"))


def _synthetic(deadzone: bool):
    def q(spark, sf):
        recent = flt.most_recent(flt.area_band(flt.positive_price(_listings(spark, sf)), *SMALL), 1000)
        recent = recent.select(*ch.OBSERVATION_COLUMNS)
        f = synth.synthesize_moves_deadzone if deadzone else synth.synthesize_moves
        return f(recent, seed=42)
    return q


def _fallback(L):
    """The newest changes or, where no listing has one, flagged made-up moves of the newest observations."""
    primary = ch.price_changes(L, *SMALL, match="latest")
    recent = flt.most_recent(flt.area_band(flt.positive_price(L), *SMALL), 1000)
    return synth.with_fallback(primary, synth.synthesize_moves(recent, seed=42))


def _first_observations(L):
    """Listings with their oldest priced observation only, so that none has a change."""
    w = Window.partitionBy("id").orderBy(F.col("updated_at").asc_nulls_last(), "seq1", "seq2", F.col("price").asc_nulls_last())
    return (flt.with_timestamp(flt.positive_price(L)).withColumn("_n", F.row_number().over(w))
            .filter("_n = 1").drop("_n"))


QUERIES: dict[str, Query] = {
    "listings": lambda s, sf: _listings(s, sf),
    "conformed_listings": lambda s, sf: conform(untyped_listings_from_testdata(s, sf)),
    "conform_losses": lambda s, sf: conform_losses(untyped_listings_from_testdata(s, sf)),
    "area_band_small": lambda s, sf: flt.area_band(flt.positive_price(_listings(s, sf)), *SMALL),
    "area_band_medium": lambda s, sf: flt.area_band(flt.positive_price(_listings(s, sf)), *MEDIUM),
    "area_ceiling": lambda s, sf: flt.area_band(flt.positive_price(_listings(s, sf)), None, 40.0),
    "most_recent_1000": lambda s, sf: flt.most_recent(
        flt.area_band(flt.positive_price(_listings(s, sf)), *SMALL), 1000).select(
            "id", "title", "price", "rooms", "area", "location", "property_url", "updated_at"),
    "most_recent_1000_threshold": lambda s, sf: flt.most_recent(
        flt.area_band(flt.positive_price(_listings(s, sf)), *SMALL), 1000, method="threshold").select(
            "id", "title", "price", "rooms", "area", "location", "property_url", "updated_at"),
    "price_history": lambda s, sf: ch.price_history(_listings(s, sf)),
    # Ids of over about 20 observations cut into ranges, as very hot ids are at scale.
    "price_history_balanced": lambda s, sf: ch.price_history(_listings(s, sf), split_rows=20),
    "latest_changes": lambda s, sf: ch.latest_changes(_listings(s, sf), method="top2"),
    "latest_changes_window": lambda s, sf: ch.latest_changes(_listings(s, sf), method="window"),
    "price_changes_all_small": _changes("all", SMALL),
    "price_changes_all_medium": _changes("all", MEDIUM),
    "price_changes_latest_small": _changes("latest", SMALL),
    "price_changes_latest_medium": _changes("latest", MEDIUM),
    "plausible_moves": lambda s, sf: ch.plausible(ch.price_changes(_listings(s, sf), *SMALL, match="all")),
    "locations": lambda s, sf: mover_locations(_listings(s, sf), *SMALL, match="all"),
    "movers_small_all": _movers("all", SMALL),
    "movers_small_latest": _movers("latest", SMALL),
    "movers_medium_all": _movers("all", MEDIUM),
    "movers_medium_latest": _movers("latest", MEDIUM),
    "cheapest_top3": lambda s, sf: cheapest(_listings(s, sf), 40.0, 3),
    "geocoded": _geocoded,
    "centroid": lambda s, sf: centroid(_geocoded(s, sf)),
    "region_stats_topk": lambda s, sf: st.region_stats(_geocoded(s, sf)),
    "region_stats_all": lambda s, sf: st.region_stats(
        flt.area_band(flt.positive_price(_listings(s, sf)), None, 40.0)),
    "top_regions_10": lambda s, sf: st.top_regions(st.region_stats(_geocoded(s, sf)), 10),
    "chart_series": _chart,
    "markers": lambda s, sf: markers(_geocoded(s, sf)),
    "formatted_cheapest": lambda s, sf: formatted_table(_geocoded(s, sf)),
    "formatted_movers": _formatted_movers,
    "listing_blocks": _listing_blocks,
    "location_blocks": _location_blocks,
    "report_rows": _report_rows,
    "report_messages": _report_messages,
    "sanitize_pages": lambda s, sf: tp.sanitize_table(read_pages(s, sf), "html", "text").select(
        "page_id", "text", F.length("text").alias("n_chars")),
    "chunk_documents": lambda s, sf: tp.explode_chunks(read_documents(s, sf), "doc_id", "text", 3000),
    "chunk_documents_arrow": lambda s, sf: tp.explode_chunks(read_documents(s, sf), "doc_id", "text", 3000,
                                                             engine="arrow"),
    "chunk_unbroken": lambda s, sf: tp.explode_chunks(_unbroken_documents(s, sf), "doc_id", "text", 3000),
    "messages": _doc_messages,
    "messages_unbroken": _unbroken_messages,
    "page_messages": _page_messages,
    "host_chunks": _host_chunks(500_000),
    # Hosts of over about 200 units cut into segments, as very long documents are at scale.
    "host_chunks_cut": _host_chunks(200),
    "synthetic_moves": _synthetic(False),
    "synthetic_moves_deadzone": _synthetic(True),
    "fallback_moves": lambda s, sf: _fallback(_listings(s, sf)),
    "fallback_moves_empty": lambda s, sf: _fallback(_first_observations(_listings(s, sf))),
}


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _frame_ctes(key: str) -> list[str]:
    header, footer = _sql_text(tp.message_header(AS_OF)), _sql_text(tp.message_footer())
    framed = f"""framed AS (SELECT {key} AS report_id, part, n_parts,
        CASE WHEN part = 0 THEN {header} || chunk ELSE chunk END
          || CASE WHEN part = n_parts - 1 THEN {footer} ELSE '' END AS t FROM chunks)"""
    trimmed = """trimmed AS (SELECT report_id, part, n_parts,
        CASE WHEN length(t) > 4000 THEN substring(t, 1, 3997) || '...' ELSE t END AS text,
        length(t) > 4000 AS was_trimmed FROM framed)"""
    return [framed, trimmed]


_OUTBOX_SELECT = f"""SELECT report_id, part, n_parts, text, CAST(length(text) AS INTEGER) AS n_chars,
    substring(text, 1, 100) AS preview, was_trimmed,
    CASE WHEN length(text) > 1000 THEN substring(text, 1, 950) || '{tp.MESSAGE_TEXT["retry_suffix"]}' END AS retry_text
    FROM trimmed"""


def _oracles() -> dict[str, str]:
    L = [O.LISTINGS]
    W = O.with_
    out = {
        "listings": W(L, f"SELECT {O.LISTING_COLS} FROM listings"),
        "area_band_small": W(L, f"SELECT {O.LISTING_COLS} FROM listings WHERE price > 0 AND {O.band(*SMALL)}"),
        "area_band_medium": W(L, f"SELECT {O.LISTING_COLS} FROM listings WHERE price > 0 AND {O.band(*MEDIUM)}"),
        "area_ceiling": W(L, f"SELECT {O.LISTING_COLS} FROM listings WHERE price > 0 AND {O.band(None, 40.0)}"),
        "most_recent_1000": W(L, f"""SELECT id, title, price, rooms, area, location, property_url, updated_at
            FROM listings WHERE price > 0 AND {O.band(*SMALL)}
            ORDER BY updated_at DESC NULLS FIRST, seq1 DESC, seq2 DESC, price DESC, id DESC LIMIT 1000"""),
        "price_history": W(L + [O.HISTORY], "SELECT * FROM price_history"),
        "latest_changes": W(L + [O.NEWEST_TWO], "SELECT * EXCLUDE (now) FROM moved"),
    }
    out["most_recent_1000_threshold"] = out["most_recent_1000"]
    out["conformed_listings"] = W(L, """SELECT id, CASE WHEN seq1 % 23 <> 0 THEN title END AS title, CASE WHEN seq1 % 17 <> 0 THEN price END AS price,
        rooms, area, location, property_url, CASE WHEN seq1 % 19 <> 0 THEN updated_at END AS updated_at, CAST(NULL AS VARCHAR) AS geography, seq1, seq2
        FROM listings""")
    readings = (("id", "string", "bigint", "by_row", "id IS NOT NULL", "false", "false"),
                ("title", "binary", "string", "by_row", "title IS NOT NULL OR seq1 % 23 = 0", "seq1 % 23 = 0", "false"),
                ("price", "string", "double", "by_row", "price IS NOT NULL", "price IS NOT NULL AND seq1 % 17 = 0", "false"),
                ("rooms", "decimal(6,2)", "int", "by_row", "rooms IS NOT NULL", "false", "rooms IS NOT NULL AND seq1 % 5 = 0"),
                ("area", "float", "double", "lossless", "area IS NOT NULL", "false", "false"),
                ("location", "string", "string", "same", "location IS NOT NULL", "false", "false"),
                ("property_url", "string", "string", "same", "property_url IS NOT NULL", "false", "false"),
                ("updated_at", "string", "timestamp_ntz", "by_row", "updated_at IS NOT NULL OR seq1 % 19 = 0", "seq1 % 19 = 0", "false"),
                ("geography", None, "string", "absent", "false", "false", "false"),
                ("seq1", "double", "bigint", "by_row", "seq1 IS NOT NULL", "false", "false"),
                ("seq2", "string", "int", "by_row", "seq2 IS NOT NULL", "false", "seq2 IS NOT NULL AND seq1 % 3 = 0"))
    out["conform_losses"] = W(L, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {"CAST(NULL AS VARCHAR)" if s is None else f"'{s}'"} AS source_type, '{t}' AS target_type, '{k}' AS kind,
        count(*) FILTER (WHERE {n}) AS n_values, count(*) FILTER (WHERE {lost}) AS n_lost, count(*) FILTER (WHERE {changed}) AS n_changed FROM listings"""
        for c, s, t, k, n, lost, changed in readings))
    out["latest_changes_window"] = out["latest_changes"]
    out["price_history_balanced"] = out["price_history"]
    for name, match, b in (("price_changes_all_small", "all", SMALL), ("price_changes_all_medium", "all", MEDIUM),
                           ("price_changes_latest_small", "latest", SMALL),
                           ("price_changes_latest_medium", "latest", MEDIUM)):
        out[name] = W(O.changes_ctes(match, *b), f"SELECT {O.OBS_COLS}, {O.CHANGE_COLS} FROM changes")
    out["fallback_moves"] = W(O.changes_ctes("latest", *SMALL), f"SELECT {O.OBS_COLS}, {O.CHANGE_COLS}, false AS is_synthetic FROM changes")
    recent = f"""recent AS (SELECT {O.OBS_COLS} FROM listings WHERE price > 0 AND {O.band(*SMALL)}
        ORDER BY updated_at DESC NULLS FIRST, seq1 DESC, seq2 DESC, price DESC, id DESC LIMIT 1000)"""
    out["synthetic_moves"] = W(L + [recent, O.drawn(False)], O.SYNTHETIC_SELECT)
    out["synthetic_moves_deadzone"] = W(L + [recent, O.drawn(True)], O.SYNTHETIC_SELECT)
    first = [O.LISTINGS.replace("listings AS", "every AS", 1), """listings AS (SELECT DISTINCT ON (id) * FROM every
        WHERE price > 0 AND updated_at IS NOT NULL ORDER BY id, updated_at, seq1, seq2, price)"""]
    out["fallback_moves_empty"] = W(first + [recent, O.drawn(False)], f"""SELECT {O.OBS_COLS},
        CAST(NULL AS TIMESTAMP) AS current_updated_at, CAST(NULL AS TIMESTAMP) AS prev_updated_at,
        price - price * pct / 100 AS prev_price, pct AS pct_change, price * pct / 100 AS absolute_change, true AS is_synthetic FROM drawn""")
    out["plausible_moves"] = W(O.changes_ctes("all", *SMALL), """SELECT *, abs(pct_change) AS abs_pct_change
        FROM changes WHERE abs(pct_change) > 0.1 AND abs(pct_change) <= 25.0""")
    out["locations"] = W(O.changes_ctes("all", *SMALL), """SELECT DISTINCT location FROM changes
        WHERE abs(pct_change) > 0.1 AND abs(pct_change) <= 25.0 AND location IS NOT NULL AND location <> ''
        ORDER BY location""")
    for name, match, b in (("movers_small_all", "all", SMALL), ("movers_small_latest", "latest", SMALL),
                           ("movers_medium_all", "all", MEDIUM), ("movers_medium_latest", "latest", MEDIUM)):
        out[name] = W(O.movers_ctes(match, *b), "SELECT * FROM movers")
    out["cheapest_top3"] = W(L + [O.CHEAPEST], "SELECT * FROM ranked ORDER BY location NULLS LAST, rank")
    G = L + [O.CHEAPEST, *O.GEOCODED]
    out["geocoded"] = W(G, "SELECT * FROM geocoded")
    out["centroid"] = W(G, f"SELECT {O.exact_avg('latitude')} AS center_lat, {O.exact_avg('longitude')} AS center_lon FROM geocoded")
    out["region_stats_topk"] = W(G + [O.STATS], "SELECT * FROM stats")
    out["region_stats_all"] = W(L, f"""SELECT location, count(id) AS "count", min(price) AS min_price,
        max(price) AS max_price, {O.exact_avg('price')} AS avg_price
        FROM listings WHERE price > 0 AND area <= 40.0 AND location IS NOT NULL GROUP BY location""")
    top = "top AS (SELECT * FROM stats ORDER BY min_price, location LIMIT 10)"
    out["top_regions_10"] = W(G + [O.STATS, top], "SELECT * FROM top")
    out["chart_series"] = W(G + [O.STATS, top], """SELECT
        to_json(list(location ORDER BY min_price, location)) AS labels_json,
        to_json(list(min_price ORDER BY min_price, location)) AS prices_json,
        CAST(count(*) AS INTEGER) AS n_locations FROM top""")
    loc = O.esc("coalesce(location, '')")
    price = O.whole_money("price")
    out["markers"] = W(G, f"""SELECT id, location, latitude, longitude, rank,
        CASE WHEN rank = 1 THEN 'green' WHEN rank = 2 THEN 'blue' ELSE 'red' END AS color,
        {price} || ', ' || {loc} AS tooltip,
        '<a href="' || {O.esc('url')} || '" target="_blank">' || {price} || '</a><ul><li>' || format('{{:.1f}}', area)
          || ' sq m in ' || {loc} || '</li><li>No. ' || CAST(rank AS VARCHAR) || ' by price here</li></ul>' AS popup
        FROM geocoded""")
    out["formatted_cheapest"] = W(G, f"""SELECT id, {loc} AS location, {price} AS price_formatted,
        format('{{:.1f}}', area) || ' sq m' AS area_formatted, rank,
        '<a href="' || {O.esc('url')} || '" target="_blank">Open</a>' AS link FROM geocoded""")
    M = O.movers_ctes("latest", *SMALL)
    fm = f"""fm AS (SELECT location, position, id, coalesce(title, '') AS title_text,
        {O.money('price')} AS price_text, {O.money('prev_price')} AS prev_price_text,
        CASE WHEN coalesce(pct_change, 0.0) > 0 THEN '▲' ELSE '▼' END || ' '
          || CASE WHEN coalesce(pct_change, 0.0) > 0 THEN '+' ELSE '' END
          || format('{{:.2f}}', coalesce(pct_change, 0.0)) || '%' AS change_text,
        CASE WHEN current_updated_at IS NOT NULL AND prev_updated_at IS NOT NULL
             THEN strftime(current_updated_at, '%d.%m.%Y') END AS current_date_text,
        CASE WHEN current_updated_at IS NOT NULL AND prev_updated_at IS NOT NULL
             THEN strftime(prev_updated_at, '%d.%m.%Y') END AS prev_date_text,
        format('{{:.2f}}', coalesce(area, 0.0)) AS area_text,
        CAST(coalesce(rooms, 0) AS BIGINT) AS rooms_value,
        coalesce(property_url, '') AS url_text FROM movers)"""
    out["formatted_movers"] = W(M + [fm], "SELECT * FROM fm")
    nl = O.NL
    lb = f"""lb AS (SELECT location, position, id,
        '#' || CAST(position AS VARCHAR) || ' ' || title_text || {nl}
        || '- listing ' || CAST(id AS VARCHAR) || {nl}
        || '- now ' || price_text || ' AED' || {nl}
        || '- was ' || prev_price_text || ' AED' || {nl}
        || '- moved ' || change_text
        || CASE WHEN current_date_text IS NOT NULL THEN {nl} || '- seen ' || current_date_text
                || {nl} || '- before that ' || prev_date_text ELSE '' END || {nl}
        || '- size ' || area_text || ' sq m' || {nl}
        || '- rooms ' || CAST(rooms_value AS VARCHAR) || {nl}
        || '- see ' || url_text || {nl} AS block FROM fm)"""
    out["listing_blocks"] = W(M + [fm, lb], "SELECT * FROM lb")
    locb = f"""locb AS (SELECT location, count(*) AS n_listings,
        '== ' || location || {nl} || repeat('=', 12) || {nl}
        || string_agg(block, {nl} ORDER BY position) || {nl} AS block FROM lb GROUP BY location)"""
    out["location_blocks"] = W(M + [fm, lb, locb], "SELECT * FROM locb")
    title = rpt.REPORT_TEXT["title"]
    out["report_rows"] = W(M + [fm, lb, locb], f"""SELECT 0 AS seq, CAST(NULL AS VARCHAR) AS location,
        '{title}' || {nl} AS text FROM (SELECT 1 FROM locb LIMIT 1)
        UNION ALL SELECT 1 AS seq, location, block AS text FROM locb""")
    out["sanitize_pages"] = f"""SELECT page_id, {O.sanitize('html')} AS text,
        CAST(length({O.sanitize('html')}) AS INTEGER) AS n_chars FROM pages"""
    chunks = O.chunk_ctes("SELECT doc_id, text FROM documents", "doc_id", "text", 3000)
    out["chunk_documents"] = W(chunks, """SELECT doc_id, part, n_parts, chunk,
        CAST(length(chunk) AS INTEGER) AS n_chars FROM chunks""")
    out["chunk_documents_arrow"] = out["chunk_documents"]
    mchunks = O.chunk_ctes(f"SELECT doc_id, {O.sanitize('text')} AS text FROM documents", "doc_id", "text", 3000)
    out["messages"] = W(mchunks + _frame_ctes("doc_id"), _OUTBOX_SELECT)
    joined = "regexp_replace(text, '[ \\n\\r\\t]+', '', 'g')"
    unbroken = f"SELECT doc_id, CASE WHEN doc_id % 3 IN (0, 1) THEN {joined} ELSE text END AS text FROM documents"
    uchunks = O.chunk_ctes(unbroken, "doc_id", "text", 3000)
    out["chunk_unbroken"] = W(uchunks, """SELECT doc_id, part, n_parts, chunk,
        CAST(length(chunk) AS INTEGER) AS n_chars FROM chunks""")
    out["messages_unbroken"] = W(uchunks + _frame_ctes("doc_id"), _OUTBOX_SELECT)
    pchunks = O.chunk_ctes(f"SELECT page_id, {O.sanitize('html')} AS text FROM pages", "page_id", "text", 3000)
    out["page_messages"] = W(pchunks + _frame_ctes("page_id"), _OUTBOX_SELECT)
    hosts = f"""SELECT host, string_agg(text, {nl} ORDER BY page_id) AS text FROM (
        SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, {O.sanitize('html')} AS text FROM pages) GROUP BY host"""
    out["host_chunks"] = out["host_chunks_cut"] = W(O.chunk_ctes(hosts, "host", "text", 3000), "SELECT host, part, n_parts, chunk FROM chunks")
    # The per-block rule: each row of the report is sanitised, then the rows are joined.
    report = f"""report_doc AS (SELECT 'movers_small_latest' AS report_id,
        string_agg(text, {nl} ORDER BY seq, location NULLS FIRST) AS text FROM (
          SELECT seq, location, {O.sanitize('text')} AS text FROM (
            SELECT 0 AS seq, CAST(NULL AS VARCHAR) AS location, '{title}' || {nl} AS text
            FROM (SELECT 1 FROM locb LIMIT 1)
            UNION ALL SELECT 1 AS seq, location, block AS text FROM locb)) HAVING count(*) > 0)"""
    rchunks = O.chunk_ctes("SELECT report_id, text FROM report_doc", "report_id", "text", 3000)
    out["report_messages"] = W(M + [fm, lb, locb, report] + rchunks + _frame_ctes("report_id"), _OUTBOX_SELECT)
    return out


ORACLES = _oracles()
