"""The reference's three run-once jobs as one call each, writing every sink.

* ``run_movers_job``: price moves in an area band (small flats (0, 40] and
  medium flats (40, 60] are the same job with another band and title):
  report text (S3), the whole report chunked and framed into the outbox (S5).
* ``run_cheapest_job``: cheapest listings per location: marker, centre,
  stats, top-location, chart and table rows for a page (S4).

Every output lands under ``out_dir`` in a folder named
``<prefix>_<yyyyMMdd_HHmmss>`` of the run time (X9). Nothing is sent anywhere.
"""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens import sinks
from estatelens.operators.textprep import message_footer, message_header
from estatelens.plans.reports import cheapest_report, movers_report, report_messages
from estatelens.runs import RunStore


def run_name(prefix: str, as_of: datetime) -> str:
    """``<prefix>_<yyyyMMdd_HHmmss>``."""
    return f"{prefix}_{as_of:%Y%m%d_%H%M%S}"


def run_movers_job(listings: DataFrame, out_dir: str, as_of: datetime, area_lo: float = 0.0,
                   area_hi: float = 40.0, k: int = 3, match: str = "latest", prefix: str = "movers",
                   title: str | None = None, banner: str | None = None, footer: str | None = None,
                   tags: str | None = None, store: RunStore | None = None) -> dict:
    """Returns the written paths and the outbox row count; writes nothing when
    no location has a plausible move (S7). With a ``store`` both outputs are committed there
    together, and a rerun of the same run replaces them."""
    rep = movers_report(listings, area_lo, area_hi, k=k, match=match, title=title)
    base = f"{out_dir.rstrip('/')}/{run_name(prefix, as_of)}"
    # The blocks hold at most k rows per location and feed three actions; keep
    # them instead of re-running the whole pipeline (lost blocks recompute).
    rep.location_blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if sinks.is_empty(rep.location_blocks):
            return {"report": None, "outbox": None, "messages": 0}
        if store is not None:
            ordered = rep.rows.orderBy(F.col("seq"), F.col("location").asc_nulls_first()).select("text")
            name = run_name(prefix, as_of)
            messages = report_messages(rep.rows, name, message_header(as_of, banner), message_footer(footer, tags))
            paths = store.write(name, {"report": (ordered, "text"), "outbox": (messages, "parquet")})
            return {"report": paths["report"][0], "outbox": paths["outbox"][0], "messages": paths["outbox"][1]}
        sinks.write_report(rep.rows, f"{base}/report")
        outbox, obs = sinks.observe_count(
            report_messages(rep.rows, run_name(prefix, as_of), message_header(as_of, banner), message_footer(footer, tags)))
        sinks.write_outbox(outbox, f"{base}/outbox", mode="overwrite")
    finally:
        rep.location_blocks.unpersist()
    return {"report": f"{base}/report", "outbox": f"{base}/outbox", "messages": obs.get["rows"]}


def run_cheapest_job(listings: DataFrame, out_dir: str, as_of: datetime, area_hi: float = 40.0, k: int = 3,
                     top_n: int = 10, prefix: str = "lowest_prices", store: RunStore | None = None) -> dict:
    rep = cheapest_report(listings, area_hi, k, top_n)
    base = f"{out_dir.rstrip('/')}/{run_name(prefix, as_of)}"
    rep.geocoded.persist(StorageLevel.MEMORY_AND_DISK)   # <= k rows per location, six sinks
    try:
        if sinks.is_empty(rep.geocoded):
            return {}
        tables = {"markers": rep.markers, "centre": rep.centre, "stats": rep.stats,
                  "top_locations": rep.top, "chart": rep.chart, "table": rep.table}
        if store is not None:
            written = store.write(run_name(prefix, as_of), {name: (df, "parquet") for name, df in tables.items()})
            return {name: path for name, (path, _) in written.items()}
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{base}/{name}"
            sinks.write_report_table(df, paths[name])
    finally:
        rep.geocoded.unpersist()
    return paths


def run_all(listings: DataFrame, out_dir: str, as_of: datetime, small: dict | None = None,
            medium: dict | None = None, cheapest: dict | None = None) -> dict:
    """The three jobs in one run: small flats (0, 40], medium flats (40, 60], cheapest
    per location. ``small``, ``medium`` and ``cheapest`` are further arguments of each job, such as
    banner, footer and tags. Each job reads the columns and rows that it needs from the source."""
    return {
        "small": run_movers_job(listings, out_dir, as_of, 0.0, 40.0, **{"prefix": "movers_small", **(small or {})}),
        "medium": run_movers_job(listings, out_dir, as_of, 40.0, 60.0, **{"prefix": "movers_medium", **(medium or {})}),
        "cheapest": run_cheapest_job(listings, out_dir, as_of, **(cheapest or {})),
    }
