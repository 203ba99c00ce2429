"""Every registered query against its DuckDB oracle on the smallest fixture,
plus the entry() smoke check."""

import collections
import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_random():
    missing = set(E.queries()) - set(E.oracle_sql())
    assert missing <= {"pipeline"} | {n for n in E.queries() if n.startswith("op")}


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(E.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, rows) == bag(columns, found.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "location", "area", "price", "geography", "rank", "latitude", "longitude", "url"]


def test_synthetic_moves_bounds(spark):
    rows = E.queries()["synthetic_moves"](spark, SF_SMALL).collect()
    assert len(rows) == 1000
    for r in rows:
        assert -5.0 <= r.pct_change <= 8.0 and r.is_synthetic
        assert r.prev_price == pytest.approx(r.price - r.price * r.pct_change / 100)
    rows = E.queries()["synthetic_moves_deadzone"](spark, SF_SMALL).collect()
    assert all(abs(r.pct_change) > 0.1 and -5.0 <= r.pct_change <= 8.0 for r in rows)


def test_draws_do_not_depend_on_partitioning(spark):
    from estatelens.operators.synth import synthesize_moves_deadzone
    from estatelens.sources import listings_from_testdata
    L = listings_from_testdata(spark, SF_SMALL)
    a, b = (collections.Counter(map(tuple, synthesize_moves_deadzone(L.repartition(n)).collect())) for n in (2, 9))
    assert a == b


def test_fallback_rows_are_flagged(spark):
    """Made-up rows keep the primary's columns, say so, and carry no change dates (quirk Q17)."""
    real = E.queries()["fallback_moves"](spark, SF_SMALL)
    made = E.queries()["fallback_moves_empty"](spark, SF_SMALL)
    assert made.dtypes == real.dtypes
    assert [tuple(r) for r in real.select("is_synthetic").distinct().collect()] == [(False,)]
    assert made.count() > 0 and made.filter("is_synthetic AND current_updated_at IS NULL").count() == made.count()


def test_branches_are_exercised(spark):
    """The fixture holds what the filters, defaults and limits are there for."""
    from estatelens.sources import listings_from_testdata
    L = listings_from_testdata(spark, SF_SMALL)
    for condition in ("price = 0", "price < 0", "price IS NULL", "updated_at IS NULL", "area = 0", "area < 0", "area IS NULL",
                      "location = ''", "location IS NULL", "title IS NULL", "rooms IS NULL", "title LIKE '%<b>%'", "location LIKE '%&%'"):
        assert L.filter(condition).count() > 0, condition
    q = E.queries()
    assert q["area_ceiling"](spark, SF_SMALL).count() > q["area_band_small"](spark, SF_SMALL).count()
    assert q["messages_unbroken"](spark, SF_SMALL).filter("was_trimmed").count() > 0
    assert q["chunk_unbroken"](spark, SF_SMALL).filter("n_chars = 0").count() > 0


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    for name in ("price_changes_all_small", "plausible_moves", "fallback_moves", "price_history", "price_history_balanced", "report_rows"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        E.queries()[name](spark, SF_SMALL)
        assert len(tracker.getJobIdsForGroup(f"build-{name}")) == 0, name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
