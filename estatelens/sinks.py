"""Sinks (S3-S7). One action per sink; no ``collect``; no single-file coalesce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return df.isEmpty()


def observe_count(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """A row count collected as a side metric of the next action on the
    returned DataFrame, so it costs no second pass (``obs.get['rows']`` after it)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def write_report(report_rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: the report as text, one row per title/location block in document
    order (range-partitioned sort; part files concatenate in order)."""
    (report_rows.orderBy(F.col("seq"), F.col("location").asc_nulls_first())
     .select("text").write.mode(mode).text(path))


def write_report_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The formatted rows behind an HTML table or chart."""
    df.write.mode(mode).format(fmt).save(path)


def write_outbox(outbox: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """S5 re-aimed: messages land in an outbox table keyed by (report_id, part)
    for a separate sender; delivery over the network is not part of this library. A rerun replaces
    its messages; an outbox of many runs is a ``RunStore``."""
    outbox.write.mode(mode).format(fmt).save(path)
