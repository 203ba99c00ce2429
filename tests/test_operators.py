"""Operators on hand-built listings (FIXTURES.md sections 4.4 and 4.5)."""

import datetime as dt

import pytest
from pyspark.sql import Row

from estatelens.operators import changes as ch
from estatelens.operators import filters as flt
from estatelens.operators.geo import geocode
from estatelens.operators.stats import region_stats, top_regions
from estatelens.operators.topk import cheapest, price_movers
from estatelens.sources.schema import LISTING_SCHEMA, missing_columns, require_columns


def t(day):
    return None if day is None else dt.datetime(2024, 1, day)


def listings(spark, rows):
    """rows: (id, day, price, area, location, geography)"""
    data = []
    for n, (i, day, price, area, loc, geo) in enumerate(rows):
        data.append((i, f"flat {i}", price, 1, area, loc, f"u/{i}", t(day), geo, n, 1))
    return spark.createDataFrame(data, LISTING_SCHEMA)


HIST = [
    (1, 1, 100.0), (1, 2, 110.0),
    (2, 1, 100.0),
    (3, 1, 100.0), (3, 2, 0.0), (3, 3, 120.0),
    (4, 1, 100.0), (4, None, 90.0), (4, 2, 125.0),
    (5, 1, 100.0), (5, 2, 126.0),
    (6, 1, 100.0), (6, 2, 100.05),
    (7, 1, 100.0), (7, 2, 80.0), (7, 3, 88.0),
]


@pytest.fixture(scope="module")
def hist(spark):
    return listings(spark, [(i, d, p, 30.0, f"L{i % 2}", None) for i, d, p in HIST])


@pytest.mark.parametrize("method", ["top2", "window"])
def test_latest_changes(hist, method):
    got = {r.id: r for r in ch.latest_changes(hist, method=method).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7}
    assert (got[1].prev_price, got[1].pct_change, got[1].absolute_change) == (100.0, 10.0, 10.0)
    assert (got[3].prev_price, got[3].pct_change) == (100.0, 20.0)
    assert (got[4].prev_price, got[4].pct_change) == (100.0, 25.0)
    assert got[7].prev_price == 80.0 and got[7].pct_change == pytest.approx(10.0)


def test_price_changes_match_modes(hist):
    all_rows = ch.price_changes(hist, 0, 40, match="all").collect()
    latest = ch.price_changes(hist, 0, 40, match="latest").collect()
    assert sorted(r.id for r in all_rows if r.id == 7) == [7, 7, 7]
    assert sorted(r.id for r in latest) == [1, 3, 4, 5, 7]  # 6 fails the minimum move
    plaus = ch.plausible(ch.price_changes(hist, 0, 40, match="latest")).collect()
    assert sorted(r.id for r in plaus) == [1, 3, 4, 7]       # 5 (26%) fails the band; 25 stays


def test_area_bands(spark):
    areas = [-1.0, 0.0, 0.1, 40.0, 40.1, None, 60.0]
    df = listings(spark, [(i, 1, 10.0, a, "x", None) for i, a in enumerate(areas)])
    small = sorted(r.area for r in flt.area_band(df, 0, 40).collect())
    medium = sorted(r.area for r in flt.area_band(df, 40, 60).collect())
    ceiling = sorted(r.area for r in flt.area_band(df, None, 40).collect())
    assert small == [0.1, 40.0]
    assert medium == [40.1, 60.0]
    assert ceiling == [-1.0, 0.0, 0.1, 40.0]


def test_movers_ranks(hist):
    mv = price_movers(hist, 0, 40, k=3, match="all").collect()
    by_loc = {}
    for r in mv:
        by_loc.setdefault(r.location, []).append(r)
    for rows in by_loc.values():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
        assert len(rows) <= 3
        assert [r.abs_pct_change for r in rows] == sorted((r.abs_pct_change for r in rows), reverse=True)


def test_blank_locations_skipped(spark):
    rows = [(1, 1, 100.0, 30.0, None, None), (1, 2, 110.0, 30.0, None, None),
            (2, 1, 100.0, 30.0, "", None), (2, 2, 110.0, 30.0, "", None),
            (3, 1, 100.0, 30.0, "A", None), (3, 2, 110.0, 30.0, "A", None)]
    mv = price_movers(listings(spark, rows), 0, 40, match="latest").collect()
    assert [r.location for r in mv] == ["A"]


def test_cheapest_geocode_and_stats(spark):
    geo = "Широта: 25.1, Долгота: 55.2"
    rows = [(1, 1, 10.0, 30.0, "A", None), (2, 1, 20.0, 30.0, "A", geo), (3, 1, 30.0, 30.0, "A", geo),
            (4, 1, 5000.0, 30.0, "A", geo),
            (5, 1, 15.0, 30.0, "B", geo), (6, 1, 25.0, 30.0, "B", geo), (7, 1, 35.0, 30.0, "B", geo),
            (8, 1, 45.0, 30.0, "B", geo),
            (9, 1, 1.0, 30.0, None, geo), (10, 1, 1.0, 50.0, "C", geo), (11, 1, 0.0, 30.0, "C", geo)]
    df = listings(spark, rows)
    ranked = cheapest(df, 40.0, 3).collect()
    assert [(r.location, r.rank, r.id) for r in ranked] == [
        ("A", 1, 1), ("A", 2, 2), ("A", 3, 3), ("B", 1, 5), ("B", 2, 6), ("B", 3, 7), (None, 1, 9)]
    g = geocode(cheapest(df, 40.0, 3))
    assert sorted((r.location or "", r.rank) for r in g.collect()) == [
        ("", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 2), ("B", 3)]
    stats = {r.location: r for r in region_stats(g).collect()}
    assert set(stats) == {"A", "B"}          # the null location has no stats row
    assert (stats["B"]["count"], stats["B"].min_price, stats["B"].max_price, stats["B"].avg_price) == (3, 15.0, 35.0, 25.0)
    assert [r.location for r in top_regions(region_stats(g), 1).collect()] == ["B"]


def test_most_recent_nulls_first(spark):
    rows = [(1, 1, 10.0, 30.0, "A", None), (2, None, 10.0, 30.0, "A", None), (3, 3, 10.0, 30.0, "A", None)]
    got = [r.id for r in flt.most_recent(listings(spark, rows), 2).collect()]
    assert got == [2, 3]


def test_required_columns(spark):
    df = spark.createDataFrame([Row(id=1, price=1.0)])
    assert missing_columns(df) == ["updated_at"]
    with pytest.raises(ValueError, match="updated_at"):
        require_columns(df)


def test_blocks_without_date_columns(spark):
    """Rows without change-date columns print no date lines."""
    from estatelens.operators.report import listing_blocks
    rows = spark.createDataFrame(
        [("A", 1, 7, None, 110.0, 100.0, 10.0, 30.0, None, "u/7")],
        "location string, position int, id long, title string, price double, prev_price double, "
        "pct_change double, area double, rooms int, property_url string")
    block = listing_blocks(rows).first().block
    assert block.splitlines()[0] == "#1 "
    assert "- seen" not in block and "- moved ▲ +10.00%" in block
    assert block.endswith("- see u/7\n")


@pytest.mark.parametrize("match", ["all", "latest"])
def test_mover_locations_equal_fan_out(spark, match):
    from estatelens.operators.topk import locations, mover_locations
    from estatelens.sources import listings_from_testdata
    L = listings_from_testdata(spark, "/root/testdata/sf0.001")
    for band in ((0, 40), (40, 60)):
        direct = [r.location for r in locations(ch.plausible(ch.price_changes(L, *band, match=match))).collect()]
        assert [r.location for r in mover_locations(L, *band, match=match).collect()] == direct


def test_messages_framing_and_trim(spark):
    """FIXTURES 4.6: 4,001 characters become 4,000 ending in '...'; 4,000 stay.
    Header only before part 0, footer only after the last part."""
    from estatelens.operators.textprep import messages
    chunks = spark.createDataFrame(
        [(1, 0, 3, "a" * 3990), (1, 1, 3, "b" * 4001), (1, 2, 3, "c" * 3990), (2, 0, 1, "only"),
         (3, 0, 1, "d" * 4000)],
        "doc int, part int, n_parts int, chunk string")
    rows = {(r.report_id, r.part): r for r in messages(chunks, "doc", "H\n", "\nF").collect()}
    first, middle, last = rows[(1, 0)], rows[(1, 1)], rows[(1, 2)]
    assert first.text == "H\n" + "a" * 3990 and not first.was_trimmed
    assert middle.n_chars == 4000 and middle.text.endswith("...") and middle.was_trimmed
    assert last.text == "c" * 3990 + "\nF" and last.n_chars == 3992
    assert rows[(2, 0)].text == "H\nonly\nF" and rows[(2, 0)].retry_text is None
    assert rows[(3, 0)].n_chars == 4000 and rows[(3, 0)].text.endswith("...")  # 4,000 + header + footer
    assert middle.retry_text == "b" * 950 + " [cut; see the full report]"
    assert first.preview == ("H\n" + "a" * 98)
    plain = messages(spark.createDataFrame([(9, 0, 1, "e" * 4000)], "doc int, part int, n_parts int, chunk string"),
                     "doc", "", "").first()
    assert plain.n_chars == 4000 and plain.text == "e" * 4000 and not plain.was_trimmed
