"""Geography text -> coordinates (X11).

Input looks like ``<lat label><lat>, <lon label><lon>``. The labels are removed
wherever they occur, the rest must split on commas into exactly two parts, and
both parts must be plain decimal numbers; otherwise both coordinates are null.
Deliberate difference from a bare float parse (quirk Q8): ``nan``/``inf``,
digit separators and type suffixes (``1.0d``) are rejected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.text import py_strip

# The labels of the source format, the second with its leading space.
LAT_LABEL = "Широта: "
LON_LABEL = " Долгота: "
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip_ws(c: Column) -> Column:
    return py_strip(c)


def parse_geography(c) -> tuple[Column, Column]:
    """Return ``(latitude, longitude)`` double Columns; null together."""
    c = F.col(c) if isinstance(c, str) else c
    rest = F.replace(F.replace(c, F.lit(LAT_LABEL), F.lit("")), F.lit(LON_LABEL), F.lit(""))
    parts = F.split(rest, ",", -1)
    a = strip_ws(F.get(parts, 0))
    b = strip_ws(F.get(parts, 1))
    ok = (F.size(parts) == 2) & a.rlike(NUMBER_RE) & b.rlike(NUMBER_RE)
    return (F.when(ok, a.cast("double")), F.when(ok, b.cast("double")))
