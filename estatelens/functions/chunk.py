"""Greedy chunk packing (X21-X24) as one native array fold per text.

Units: each line (separator LF); a line longer than ``max_length`` is replaced
by its sentences (split after ``. ! ?`` plus whitespace, separator space); a
sentence still longer is replaced by its space-separated words. Units are
appended to the current chunk together with their separator; when
``len(current) + len(unit) + 1 > max_length`` the current chunk is emitted
stripped and the unit starts a new one. At the end a non-blank current chunk
is emitted (quirks Q15/Q16: a unit of exactly ``max_length`` first emits an
empty chunk; a word is never cut; empty text gives no chunk).

Only chunk *start indexes* are folded (ints, no string building per step);
each chunk's text is assembled once afterwards from a slice of the units, so
the work is linear in the text length. The whole text is always processed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions.text import PY_WS, py_strip

SENTENCE_SPLIT_RE = f"(?<=[.!?]){PY_WS}+"


def _unit(u: Column, sep: str) -> Column:
    return F.struct(u.alias("u"), F.lit(sep).alias("sep"))


def chunk_units(text, max_length: int = 3000) -> Column:
    """``array<struct<u: string, sep: string>>`` of packing units."""
    text = F.col(text) if isinstance(text, str) else text
    m = F.lit(max_length)

    def sentence_units(s: Column) -> Column:
        return F.when(F.length(s) > m, F.transform(F.split(s, " ", -1), lambda w: _unit(w, " "))) \
                .otherwise(F.array(_unit(s, " ")))

    def paragraph_units(p: Column) -> Column:
        long_p = F.flatten(F.transform(F.split(p, SENTENCE_SPLIT_RE, -1), sentence_units))
        return F.when(F.length(p) > m, long_p).otherwise(F.array(_unit(p, "\n")))

    return F.flatten(F.transform(F.split(text, "\n", -1), paragraph_units))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` (a one-element
    ``transform``). Reusing a Python Column object instead would copy its whole
    expression tree, and Spark would evaluate it once per copy."""
    return F.get(F.transform(F.array(value), body), 0)


def pack_chunks(text, max_length: int = 3000, drop_empty: bool = False) -> Column:
    """``array<string>`` of chunks, in order. Null text gives null."""
    return let(chunk_units(text, max_length), lambda units: _pack(units, max_length, drop_empty))


def _pack(units: Column, max_length: int, drop_empty: bool) -> Column:
    init = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("len"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        # Cheap scalar subexpressions are simply repeated: a ``let`` here would
        # allocate an array per unit.
        ulen = F.length(x["u"]) + F.lit(1)
        flush = acc["len"] + ulen > F.lit(max_length)
        return F.struct(
            F.when(flush, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
            F.when(flush, ulen).otherwise(acc["len"] + ulen).alias("len"),
            (acc["i"] + F.lit(1)).alias("i"),
        )

    def texts(starts: Column) -> Column:
        n, n_starts = F.size(units), F.size(starts)

        def chunk_at(s: Column, k: Column) -> Column:
            end = F.when(k + 1 < n_starts, F.get(starts, k + 1)).otherwise(n)
            body = F.slice(units, s + 1, end - s)
            return py_strip(F.array_join(F.transform(body, lambda x: F.concat(x["u"], x["sep"])), ""))

        def finish(chunks: Column) -> Column:
            # The last (unflushed) chunk is emitted only when it is not blank.
            last_blank = F.get(chunks, n_starts - 1) == F.lit("")
            out = F.when(last_blank, F.slice(chunks, 1, n_starts - 1)).otherwise(chunks)
            return F.filter(out, lambda c: c != F.lit("")) if drop_empty else out

        return let(F.transform(starts, chunk_at), finish)

    return let(F.aggregate(units, init, step)["starts"], texts)


# Arrow variant (same specification, one Python function per batch of texts):
# timed against the native fold in bench.py (``chunk_documents_arrow``).

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _py_units(text: str, max_length: int):
    for line in text.split("\n"):
        if len(line) <= max_length:
            yield line, "\n"
            continue
        for sentence in _SENTENCE_END.split(line):
            words = sentence.split(" ") if len(sentence) > max_length else [sentence]
            for w in words:
                yield w, " "


def _py_pack(text, max_length: int):
    if text is None:
        return None
    out, current = [], []
    size = 0
    for unit, sep in _py_units(text, max_length):
        if size + len(unit) + 1 > max_length:
            out.append("".join(current).strip())
            current, size = [], 0
        current.append(unit + sep)
        size += len(unit) + 1
    tail = "".join(current).strip()
    return out + [tail] if tail else out


def pack_chunks_arrow(text, max_length: int = 3000) -> Column:
    """X24 as an Arrow-batched pandas UDF; equal to ``pack_chunks``."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _py_pack(t, max_length))

    return pack(F.col(text) if isinstance(text, str) else text)
