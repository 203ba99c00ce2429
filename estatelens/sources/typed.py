"""Typed conformance (S1, S2, E6): how each column of a source is read as its column of ``LISTING_SCHEMA``.

Every pair of a source and a target type has a kind: ``same``; ``lossless`` (every value has its counterpart);
``by_row`` (it depends on the value: a number out of range, a fraction cut off, a text that is no number); or
``unreadable`` (a date for a number, a nested value). The kind decides the cast, so a number never takes
the way through text, and what a cast can't read becomes null and is counted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.sources.schema import LISTING_SCHEMA, REQUIRED_FOR_CHANGES, require_columns

SAME, LOSSLESS, BY_ROW, UNREADABLE, ABSENT = "same", "lossless", "by_row", "unreadable", "absent"

# Decimal digits that every value of an integer type has room for, and its bits of value.
INTEGERS = {T.ByteType: (2, 7), T.ShortType: (4, 15), T.IntegerType: (9, 31), T.LongType: (18, 63)}
# Bits of a whole number that a binary fraction holds exactly.
FRACTIONS = {T.FloatType: 24, T.DoubleType: 53}
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class Reading(NamedTuple):
    """How a column is read: the kind, the value, and whether a value that is read differs from what stood there."""

    kind: str
    value: Column
    changed: Column


def _whole(source: T.DataType, target: T.DataType) -> str:
    digits, bits = INTEGERS[type(target)]
    if isinstance(source, T.BooleanType):
        return LOSSLESS
    if type(source) in INTEGERS:
        return LOSSLESS if INTEGERS[type(source)][1] <= bits else BY_ROW
    if isinstance(source, T.DecimalType):
        return LOSSLESS if source.scale <= 0 and source.precision <= digits else BY_ROW
    return BY_ROW if type(source) in FRACTIONS or isinstance(source, T.StringType) else UNREADABLE


def _fraction(source: T.DataType, target: T.DataType) -> str:
    bits = FRACTIONS[type(target)]
    if isinstance(source, T.BooleanType):
        return LOSSLESS
    if type(source) in INTEGERS:
        return LOSSLESS if INTEGERS[type(source)][1] <= bits else BY_ROW
    if type(source) in FRACTIONS:
        return LOSSLESS if FRACTIONS[type(source)] <= bits else BY_ROW
    return BY_ROW if isinstance(source, (T.DecimalType, T.StringType)) else UNREADABLE


def kind_of(source: T.DataType, target: T.DataType) -> str:
    """The kind of reading ``source`` as ``target``."""
    if source == target:
        return SAME
    if isinstance(source, T.NullType):
        return LOSSLESS
    if type(target) in INTEGERS:
        return _whole(source, target)
    if type(target) in FRACTIONS:
        return _fraction(source, target)
    if isinstance(target, T.StringType):
        if isinstance(source, T.BinaryType):
            return BY_ROW
        nested = isinstance(source, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        return UNREADABLE if nested else LOSSLESS
    if isinstance(target, TIMES):
        if isinstance(source, T.StringType):
            return BY_ROW
        if isinstance(source, TIMES):
            return BY_ROW if isinstance(target, T.DateType) else LOSSLESS
    return UNREADABLE


def reading(column: Column, source: T.DataType, target: T.DataType) -> Reading:
    """``column`` of type ``source`` as ``target``; what can't be read is null.

    Numbers become whole numbers by truncation toward zero (E6); texts do so by way of the number that they
    write, so ``2``, ``2.0``, `` 2.9 `` and ``2e0`` are the same whole number. Bytes are text where they are UTF-8."""
    kind, never = kind_of(source, target), F.lit(False)
    if kind == SAME:
        return Reading(kind, column, never)
    if kind == UNREADABLE:
        return Reading(kind, F.lit(None).cast(target), never)
    if isinstance(source, T.NullType):
        return Reading(LOSSLESS, column.cast(target), never)
    if type(target) in INTEGERS:
        if isinstance(source, T.StringType):
            text = F.btrim(column)
            exact, number = text.try_cast(target), text.try_cast("double")
            value = F.coalesce(exact, number.try_cast(target))
            return Reading(kind, value, F.coalesce(exact.isNull() & (number != value.cast("double")), never))
        value = column.try_cast(target)
        fractional = type(source) in FRACTIONS or (isinstance(source, T.DecimalType) and source.scale > 0)
        return Reading(kind, value, F.coalesce(value.cast(source) != column, never) if fractional else never)
    if type(target) in FRACTIONS:
        value = (F.btrim(column) if isinstance(source, T.StringType) else column).try_cast(target)
        return Reading(kind, value, F.coalesce(value.try_cast(source) != column, never) if type(source) in INTEGERS and kind == BY_ROW else never)
    if isinstance(source, T.BinaryType):
        text = column.cast("string")
        return Reading(kind, F.when(F.is_valid_utf8(text), text), never)
    value = (F.btrim(column) if isinstance(source, T.StringType) else column).try_cast(target)
    return Reading(kind, value, never)


class Probe(NamedTuple):
    """What S2 finds of one column of the target: its source type (None if absent), its target type and the kind."""

    column: str
    source_type: str | None
    target_type: str
    kind: str


def probe(df: DataFrame, schema: T.StructType = LISTING_SCHEMA) -> list[Probe]:
    """Names and types of all columns of ``schema`` against ``df``. Reads no data."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [Probe(f.name, have[f.name].simpleString() if f.name in have else None, f.dataType.simpleString(),
                  kind_of(have[f.name], f.dataType) if f.name in have else ABSENT) for f in schema.fields]


def require_readable(df: DataFrame, required=REQUIRED_FOR_CHANGES, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """Fail early where a required column is absent or of a type that has no reading, naming column and types."""
    require_columns(df, required)
    wrong = [p for p in probe(df, schema) if p.column in required and p.kind == UNREADABLE]
    if wrong:
        raise ValueError("listings table has required columns that can't be read: "
                         + ", ".join(f"{p.column} ({p.source_type} as {p.target_type})" for p in wrong))
    return df


def _readings(df: DataFrame, schema: T.StructType) -> dict[str, Reading]:
    have = {f.name: f.dataType for f in df.schema.fields}
    return {f.name: reading(F.col(f.name), have[f.name], f.dataType) for f in schema.fields if f.name in have}


def _counts(readings: dict[str, Reading]) -> list[Column]:
    out = []
    for name, r in readings.items():
        out += [F.count(name).alias(f"{name}.n_values"), F.count_if(F.col(name).isNotNull() & r.value.isNull()).alias(f"{name}.n_lost"),
                F.count_if(r.changed).alias(f"{name}.n_changed")]
    return out


def conform(df: DataFrame, required=REQUIRED_FOR_CHANGES, schema: T.StructType = LISTING_SCHEMA, losses: Observation | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``. Columns in ``required`` must exist and be readable; other absent
    ones become typed nulls. A value that can't be read becomes null, but an ``id`` that can't be read is an
    error: rows without it would join nothing.

    ``losses`` observes, while the result is computed and without a pass of its own, how many values of each
    column there were, were lost and were changed: ``losses_of(observation.get)``."""
    require_readable(df, required, schema)
    readings = _readings(df, schema)
    if losses is not None:
        df = df.observe(losses, *_counts(readings))
    cols = []
    for f in schema.fields:
        r = readings.get(f.name)
        value = F.lit(None).cast(f.dataType) if r is None else r.value
        if r is not None and not f.nullable:
            said = F.concat(F.lit(f"{f.name} can't be read as {f.dataType.simpleString()}: "), F.col(f.name).cast("string"))
            unread = F.when(F.col(f.name).isNotNull() & r.value.isNull(), F.raise_error(said).cast(f.dataType))
            value = F.coalesce(value, unread) if r.kind == BY_ROW else value
        cols.append(value.alias(f.name))
    return df.select(*cols)


def losses_of(counts: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """An observation's counts by column: values, lost, changed."""
    names = dict.fromkeys(k.rsplit(".", 1)[0] for k in counts)
    return {n: (counts[f"{n}.n_values"], counts[f"{n}.n_lost"], counts[f"{n}.n_changed"]) for n in names}


def conform_losses(df: DataFrame, schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """The same as a table, a row per column of ``schema``: ``(column, source_type, target_type, kind, n_values, n_lost, n_changed)``, in one
    aggregate over ``df``. Absent columns have no values."""
    readings = _readings(df, schema)
    found = {p.column: p for p in probe(df, schema)}
    counts = df.agg(*[F.struct(*_counts({n: r})[0:3]).alias(n) for n, r in readings.items()]) if readings else None

    def row(p: Probe) -> Column:
        numbers = [F.col(f"`{p.column}`.`{p.column}.{c}`") if p.kind != ABSENT else F.lit(0).cast("long") for c in ("n_values", "n_lost", "n_changed")]
        return F.struct(F.lit(p.column).alias("column"), F.lit(p.source_type).cast("string").alias("source_type"), F.lit(p.target_type).alias("target_type"),
                        F.lit(p.kind).alias("kind"), *[n.alias(c) for n, c in zip(numbers, ("n_values", "n_lost", "n_changed"))])
    counts = df.sparkSession.range(1) if counts is None else counts
    return counts.select(F.explode(F.array(*[row(p) for p in found.values()])).alias("r")).select("r.*")
