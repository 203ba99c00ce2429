"""Row counts recorded in FIXTURES.md section 2 (sf0.001)."""

import pytest

from estatelens.operators import changes as ch
from estatelens.operators import filters as flt
from estatelens.operators.geo import geocode
from estatelens.operators.stats import region_stats
from estatelens.operators.topk import cheapest, price_movers
from estatelens.sources import listings_from_testdata
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def L(spark):
    return listings_from_testdata(spark, SF_SMALL)


@pytest.mark.parametrize("match,band,changes,movers", [
    ("all", (0, 40), 4703, 63), ("all", (40, 60), 1043, 39),
    ("latest", (0, 40), 158, 35), ("latest", (40, 60), 34, 15),
])
def test_changes_and_movers(L, match, band, changes, movers):
    assert ch.price_changes(L, *band, match=match).count() == changes
    assert price_movers(L, *band, k=3, match=match).count() == movers


def test_cheapest_and_stats(L):
    assert L.count() == 6000
    assert cheapest(L, 40.0, 3).count() == 96
    g = geocode(cheapest(L, 40.0, 3))
    assert g.count() == 84
    assert region_stats(g).count() == 31
    assert flt.most_recent(flt.area_band(flt.positive_price(L), 0, 40), 1000).count() == 1000
