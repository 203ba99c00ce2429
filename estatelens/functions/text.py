"""Whitespace class shared by trimming, sentence splitting and the SQL oracles."""

from __future__ import annotations


def _py_whitespace_class() -> str:
    """Regex class of exactly the characters Python's ``str.isspace`` accepts,
    written with ``\\x{..}`` escapes understood by both Java regex and RE2.
    Built by rule from the Unicode database, not listed by hand."""
    cps = [c for c in range(0x110000) if chr(c).isspace()]
    ranges, start, prev = [], cps[0], cps[0]
    for c in cps[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        ranges.append((start, prev))
        if c is not None:
            start = prev = c
    parts = [f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges]
    return "[" + "".join(parts) + "]"


PY_WS = _py_whitespace_class()

# The same characters as a plain string, for ``btrim``.
PY_WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def py_strip(c):
    """Python's ``str.strip()``: remove those characters from both ends
    (``btrim`` walks code points from each end; no regex)."""
    from pyspark.sql import functions as F

    return F.call_function("btrim", c, F.lit(PY_WS_CHARS))
