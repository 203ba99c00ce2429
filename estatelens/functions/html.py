"""HTML sanitising for chat text.

Order matters: entities are decoded first, so an encoded tag becomes a tag and
is then stripped; what is left is escaped again and control characters go.
All four steps are Spark expressions; decoding knows the full HTML5 entity table,
also legacy names without ``;`` (``entities``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.entities import unescape

# Fixed values (must equal the reference's): a tag is "<", at least one
# character other than ">", then ">"; removed controls are C0 except tab, LF
# and CR, then DEL and C1.
TAG_RE = r"<[^>]+>"
CONTROL_RE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def strip_tags(c: Column) -> Column:
    """Remove ``<...>`` with at least one character inside (spans lines)."""
    return F.regexp_replace(c, TAG_RE, "")


def escape_specials(c: Column) -> Column:
    """``&`` first, then ``<`` and ``>``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_controls(c: Column) -> Column:
    """X19."""
    return F.regexp_replace(c, CONTROL_RE, "")


def sanitize(c) -> Column:
    """X20 = X16 -> X17 -> X18 -> X19. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return strip_controls(escape_specials(strip_tags(unescape(c))))
