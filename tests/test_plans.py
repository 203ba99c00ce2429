"""Physical plan shape: the scale properties the design relies on."""

import pytest

from estatelens.plans.registry import QUERIES
from tests.conftest import SF_SMALL


def plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["movers_small_all", "movers_medium_latest", "cheapest_top3", "latest_changes"])
def test_topk_cut_before_shuffle(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p
    assert "Partial" in p


def test_most_recent_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "most_recent_1000")


def test_filters_reach_scan(spark):
    import tempfile

    from estatelens.operators import filters as flt
    from estatelens.sources import listings_from_testdata, read_listings
    path = tempfile.mkdtemp(prefix="estatelens-plan-") + "/listings"
    listings_from_testdata(spark, SF_SMALL).write.parquet(path)
    df = flt.area_band(flt.positive_price(read_listings(spark, "parquet", path)), 0.0, 40.0).select("id")
    p = df._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThan(price,0.0)", "GreaterThan(area,0.0)", "LessThanOrEqual(area,40.0)"):
        assert pushed in p
    assert "ReadSchema: struct<id:bigint,price:double,area:double>" in p


def test_latest_mode_has_no_join(spark):
    p = plan(spark, "price_changes_latest_small")
    # only the listings-building join (lineitem x part), no self-join on id
    assert p.count("Join") == 1


def test_history_windows_share_one_shuffle_per_range(spark):
    p = plan(spark, "price_history")
    assert p.count("Exchange hashpartitioning(id#") >= 1 and "CartesianProduct" not in p and "NestedLoop" not in p


def test_report_title_reuses_the_blocks(spark):
    df = QUERIES["report_rows"](spark, SF_SMALL)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "FlatMapGroupsInArrow")
# The packer of long documents numbers chunks in Arrow passes; the Arrow chunker is Python by name.
WITH_PYTHON = ("report_messages", "host_chunks", "host_chunks_cut", "chunk_documents_arrow")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITH_PYTHON])
def test_no_python_in_plan(spark, name):
    p = plan(spark, name)
    assert not any(node in p for node in PYTHON_NODES)


@pytest.mark.parametrize("name", ["report_messages", "host_chunks"])
def test_long_documents_use_python_only_in_scan_passes(spark, name):
    """Decoding is native, and chunk texts are put together by a JVM aggregate."""
    p = plan(spark, name)
    assert "MapInArrow" in p and "ArrowEvalPython" not in p and "MapInPandas" not in p
