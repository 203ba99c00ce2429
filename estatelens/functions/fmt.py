"""Number, date, URL and HTML-fragment formatting.

``format_number`` rounds the exact binary value half-even, like Python's
``format(x, ',.2f')``; ``format_string('%,.2f')`` would round 0.125 up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_if_null(c) -> Column:
    """null (and NaN) numbers print as 0."""
    c = _c(c)
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def money(c, decimals: int = 2) -> Column:
    """``1,234,567.89``; null prints as 0.00."""
    return F.format_number(zero_if_null(c), decimals)


def fixed(c, decimals: int = 2) -> Column:
    """Fixed decimals, no thousands separator (``35.50``)."""
    pattern = "0." + "0" * decimals if decimals > 0 else "0"
    return F.call_function("format_number", _c(c).cast("double"), F.lit(pattern))


def whole_money(c, currency: str = "AED") -> Column:
    """Whole units with thousands commas and a currency: ``1,999 AED``; NaN and
    numbers beyond 64 bits print as 0, null stays null."""
    whole = F.coalesce(_c(c).cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(_c(c).isNotNull(), F.concat(F.format_number(whole, 0), F.lit(" " + currency)))


def int_or_zero(c) -> Column:
    """E6 + F13 for counts such as rooms: ``2.7 -> 2``; null, text, NaN or out of range -> 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def direction(c, up: str = "▲", down: str = "▼") -> Column:
    """Up mark when the move is positive, down mark otherwise."""
    return F.when(_c(c) > 0, F.lit(up)).otherwise(F.lit(down))


def signed_pct(c, up: str = "▲", down: str = "▼") -> Column:
    """``▲ +3.45%`` / ``▼ -2.10%``; the sign only for positive moves."""
    v = zero_if_null(c)
    sign = F.when(v > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(direction(v, up, down), F.lit(" "), sign, fixed(v, 2), F.lit("%"))


def date_text(c, pattern: str = "dd.MM.yyyy") -> Column:
    """``05.03.2024``; a text that is no date prints as it is, as any other value does."""
    text = _c(c).cast("string")
    return F.coalesce(F.date_format(text.try_cast("timestamp_ntz"), pattern), text)


def html_escape(c) -> Column:
    """X18 (+ the double quote, for attribute values): ``&`` first, then ``<``, ``>``."""
    c = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def listing_url(id_col, base: str = "https://listings.example/property/") -> Column:
    """The listing page of an id."""
    return F.concat(F.lit(base), _c(id_col).cast("string"), F.lit("/"))


def link(url, label: str = "Open") -> Column:
    """Anchor opening in a new tab."""
    return F.concat(F.lit('<a href="'), html_escape(url), F.lit('" target="_blank">'),
                    F.lit(label), F.lit("</a>"))
