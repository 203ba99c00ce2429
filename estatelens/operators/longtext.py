"""Exact greedy chunking of many documents, each held as any number of ordered rows.

The reference chunks its whole report as one string (X24 after X8). Here a document never has to exist as one
value: its rows are cut into packing units, and the greedy fold runs as a segmented scan.

The fold's state between two units is the length of the current chunk (capped at ``max_length``: any longer value
forces a flush on the next unit) and whether it holds text. What a run of units does to that state is a
*transfer function*: given the incoming length, the first flush happens at the first unit where the running length
exceeds the limit, and from that unit on everything is fixed. So the function has at most as many pieces as there are
units in the first ``max_length`` characters, and so has the composition of two.

1. Large documents are cut into segments of about equal unit counts (``ranges``); most documents are one segment.
2. Each segment of a large document is summarised as its transfer function.
3. A keyed tree composes the functions of ``FAN`` neighbours at a time, level by level, until a document has one group;
   going back down, each segment gets the state that it starts with. All of it runs on executors, for all
   documents at once; the driver only learns how many segments the largest document has.
4. Each segment numbers the chunks of its units, and a chunk is put together from at most ``max_length`` characters.

Without large documents, steps 2 and 3 don't run. Nothing depends on how rows are spread: segments are told apart by
values, so a lost task finds the same units again."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.chunk import chunk_units
from estatelens.functions.text import py_strip
from estatelens.operators.ranges import cut_ranges, range_bounds
from estatelens.session import ensure_checkpoint_dir

# Units of a document that one task holds, about.
UNITS_PER_SEGMENT = 500_000
# Neighbours that one task composes on a level of the tree.
FAN = 64

FUNCTION = "total long, any_text boolean, lo array<long>, hi array<long>, out array<long>, flushes array<long>, text array<boolean>"
START = "state long, offset long, has_text boolean"


def _prefix(w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(w, dtype=np.int64)])


def _next_flush(P: np.ndarray, m: int) -> np.ndarray:
    """nxt[j] (1-based j, index 0 unused): with a chunk started at unit j, the
    unit that flushes it next; n+1 when none in this segment."""
    n = len(P) - 1
    j = np.arange(1, n + 1)
    k = np.searchsorted(P, P[j - 1] + m, side="right")
    nxt = np.maximum(k, j + 1)
    out = np.empty(n + 1, dtype=np.int64)
    out[0] = 0
    out[1:] = np.where(nxt <= n, nxt, n + 1)
    return out


def _chain_ends(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every unit j: the last chunk start reached from j, and the number of
    flushes on the way (pointer doubling, O(n log n) vectorised)."""
    n = len(nxt) - 1
    idx = np.arange(n + 1)
    term = nxt > n
    jump = np.where(term, idx, nxt)
    cnt = np.where(term, 0, 1).astype(np.int64)
    for _ in range(max(1, int(math.ceil(math.log2(n + 1))) + 1)):
        cnt = cnt + cnt[jump]
        jump = jump[jump]
    return jump, cnt


class Transfer:
    """What a run of units does to the state: an incoming length up to ``m - total`` grows by ``total``; one from ``lo[i]`` to
    ``hi[i]`` (falling, next to each other) is flushed ``flushes[i]`` times and becomes ``out[i]``, with text or not."""

    def __init__(self, total: int, any_text: bool, lo, hi, out, flushes, text):
        self.total, self.any_text = total, any_text
        self.lo, self.hi, self.out, self.flushes = (np.asarray(x, np.int64) for x in (lo, hi, out, flushes))
        self.text = np.asarray(text, bool)

    def apply(self, m: int, state, offset, text):
        """States, chunks and text flags (arrays) after the run."""
        state, offset, text = np.atleast_1d(state), np.atleast_1d(offset), np.atleast_1d(text)
        through = state + self.total <= m
        if not len(self.lo):
            return state + self.total, offset, text | self.any_text
        at = np.minimum(np.searchsorted(-self.lo, -state, side="left"), len(self.lo) - 1)
        return (np.where(through, state + self.total, self.out[at]), offset + np.where(through, 0, self.flushes[at]),
                np.where(through, text | self.any_text, self.text[at]))

    def then(self, m: int, after: Transfer) -> Transfer:
        """This run followed by ``after``."""
        out, flushes, text = after.apply(m, self.out, self.flushes, self.text) if len(self.out) else (self.out, self.flushes, self.text)
        # Lengths that pass through this run meet the pieces of the next one, further on by what was added.
        met = after.hi >= self.total
        lo, hi = np.maximum(after.lo[met] - self.total, 0), np.minimum(after.hi[met], m) - self.total
        return Transfer(min(self.total + after.total, m + 1), self.any_text or after.any_text, np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi]),
                        np.concatenate([out, after.out[met]]), np.concatenate([flushes, after.flushes[met]]), np.concatenate([text, after.text[met]]))

    def row(self) -> list:
        return [self.total, self.any_text, *[x.tolist() for x in (self.lo, self.hi, self.out, self.flushes, self.text)]]


def _transfer(w: np.ndarray, has_text: np.ndarray, m: int) -> Transfer:
    """The transfer function of units with the widths ``w``."""
    P = _prefix(w)
    n, total = len(w), int(P[-1])
    nxt = _next_flush(P, m)
    end, cnt = _chain_ends(nxt)
    first = np.arange(1, n + 1)
    first = first[P[first - 1] <= m]  # units that can be the first to flush: incoming lengths in (m - P[j], m - P[j-1]]
    lo, hi = np.maximum(0, m - P[first] + 1), m - P[first - 1]
    first, lo, hi = first[lo <= hi], lo[lo <= hi], hi[lo <= hi]
    last_text = int(np.flatnonzero(has_text)[-1]) + 1 if has_text.any() else 0
    e = end[first]
    return Transfer(min(total, m + 1), bool(has_text.any()), lo, hi, np.minimum(m, total - P[e - 1]), 1 + cnt[first], last_text >= e)


def _runs(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``group`` values (numbers), one run in memory at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(group).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(group)[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _summaries(m: int, names: list[str]) -> Callable:
    def run(batches):
        for units in _runs(batches, "_group"):
            f = _transfer(units.column("w").to_numpy(), units.column("has_text").to_numpy(), m)
            yield pa.RecordBatch.from_arrays([units.column(c).slice(0, 1).combine_chunks().cast(units.schema.field(c).type) for c in names[:2]]
                                             + [pa.array([v], t) for v, t in zip(f.row(), _FUNCTION_TYPES)], names)
    return run


_FUNCTION_TYPES = [pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.bool_())]
_FUNCTION_NAMES = [c.split()[0] for c in FUNCTION.split(", ")]


def _functions(table: pa.Table) -> list[Transfer]:
    return [Transfer(*values) for values in zip(*[table.column(c).to_pylist() for c in _FUNCTION_NAMES])]


def _composed(m: int, key: str) -> Callable:
    """One function of the neighbours in a group."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        first, *rest = _functions(table)
        for f in rest:
            first = first.then(m, f)
        return pa.table([table.column(key).slice(0, 1), table.column("parent").slice(0, 1), *[pa.array([v], t) for v, t in zip(first.row(), _FUNCTION_TYPES)]],
                        names=[key, "block", *_FUNCTION_NAMES])
    return run


def _started(m: int, key: str) -> Callable:
    """The state that each neighbour in a group starts with, from that of the first; and what the last one leaves, as the row of block -1."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, offset, text = (np.asarray([table.column(c)[0].as_py()]) for c in ("state", "offset", "has_text"))
        rows = []
        for block, f in zip(table.column("block").to_pylist(), _functions(table)):
            rows.append((block, int(state[0]), int(offset[0]), bool(text[0]), None))
            state, offset, text = f.apply(m, state, offset, text)
        rows.append((-1, int(state[0]), int(offset[0]), bool(text[0]), table.column("parent")[0].as_py()))
        blocks, states, offsets, texts, parents = zip(*rows)
        keys = table.column(key).combine_chunks().take(pa.array([0] * len(rows)))
        return pa.table([keys, pa.array(blocks, pa.int64()), pa.array(states, pa.int64()), pa.array(offsets, pa.int64()), pa.array(texts, pa.bool_()), pa.array(parents, pa.int64())],
                        names=[key, "block", "state", "offset", "has_text", "parent"])
    return run


def _starts(functions: DataFrame, key: str, m: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """``(key, block, state, offset)`` for all ``functions`` (key, block, ...) of documents with up to ``segments`` blocks, and ``(key, n_parts)``."""
    levels = [functions]
    of = functions.schema[key].dataType.simpleString()
    while segments > FAN:
        up = levels[-1].withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(up.groupBy(key, "parent").applyInArrow(_composed(m, key), f"`{key}` {of}, block long, {FUNCTION}"))
        segments = math.ceil(segments / FAN)
    schema = f"`{key}` {of}, block long, {START}, parent long"
    top = levels[-1].withColumns({"parent": F.lit(0).cast("long"), "state": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "has_text": F.lit(False)})
    starts = top.groupBy(key, "parent").applyInArrow(_started(m, key), schema)
    # What the last block of the whole document leaves: its last chunk counts if it holds text.
    parts = starts.filter("block = -1").select(key, (F.col("offset") + F.col("has_text").cast("long")).alias("n_parts"))
    for level in reversed(levels[:-1]):
        given = starts.filter("block >= 0").select(key, F.col("block").alias("parent"), "state", "offset", "has_text")
        joined = level.withColumn("parent", F.floor(F.col("block") / FAN)).join(given, [key, "parent"])
        starts = joined.groupBy(key, "parent").applyInArrow(_started(m, key), schema)
    return starts.filter("block >= 0").select(key, F.col("block").alias("_range"), "state", "offset"), parts


def _numbered(m: int, names: list[str]) -> Callable:
    """Units with the number of their chunk and their place in the segment. Where the very first unit of a document flushes
    the empty chunk 0, a unit without text stands for that. Documents of one segment learn their number of chunks here."""
    def run(batches):
        for units in _runs(batches, "_group"):
            state, offset = units.column("state")[0].as_py(), units.column("offset")[0].as_py()
            P = _prefix(units.column("w").to_numpy())
            n, flushes = units.num_rows, []
            if state + P[n] > m:
                nxt = _next_flush(P, m)
                j = int(np.searchsorted(P[1:], m - state, side="right")) + 1
                while j <= n:
                    flushes.append(j)
                    j = int(nxt[j])
            chunk = offset + np.searchsorted(np.asarray(flushes, dtype=np.int64), np.arange(1, n + 1), side="right")
            parts = units.column("n_parts")[0].as_py()
            if parts is None:
                last = flushes[-1] - 1 if flushes else 0
                parts = int(chunk[-1]) + bool(units.column("has_text").to_numpy()[last:].any())
            out = units.drop_columns(["_group", "w", "has_text", "state", "offset", "n_parts"])
            out = out.append_column("chunk", pa.array(chunk, pa.int64())).append_column("idx", pa.array(np.arange(n), pa.int64()))
            out = out.append_column("n_parts", pa.array([parts] * n, pa.int64()))
            if state == 0 and offset == 0 and flushes[:1] == [1]:
                head = out.slice(0, 1)
                for c, v in (("u", ""), ("sep", ""), ("chunk", 0), ("idx", -1)):
                    i = head.schema.get_field_index(c)
                    head = head.set_column(i, head.schema.field(i), pa.array([v], head.schema.field(i).type))
                out = pa.concat_tables([head, out])
            yield from out.select(names).to_batches(max_chunksize=10_000)
    return run


def pack_documents(rows: DataFrame, key: str, order_cols: list[str], text_col: str, max_length: int = 3000,
                   units_per_segment: int = UNITS_PER_SEGMENT) -> DataFrame:
    """Chunks ``(key, part, n_parts, chunk)`` of the documents that the rows of each ``key`` make: their
    ``text_col`` joined with newlines in ``order_cols`` order. Equal to running the greedy packer on each whole
    string (``pack_chunks``).

    ``order_cols`` must identify a row of a key (ties would leave the order undefined). A null text
    contributes no line, a document of null texts has no chunk; rows with a null key make one document,
    which is never cut. One small action finds the largest document; the rest is lazy."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    m = int(max_length)
    lines = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_line", "_l"))
    order = [*[f"_o{i}" for i in range(len(order_cols))], "_line"]
    units = lines.select("_key", *order, F.posexplode(chunk_units(F.col("_l"), m)).alias("_unit", "_x")).select(
        "_key", *order, "_unit", F.col("_x.u").alias("u"), F.col("_x.sep").alias("sep"), (F.length("_x.u") + 1).cast("long").alias("w"),
        (F.length(py_strip(F.col("_x.u"))) > 0).alias("has_text"))
    order.append("_unit")
    place = F.struct(*order)
    bounds = range_bounds(units, "_key", place, units_per_segment).checkpoint()
    most = bounds.agg(F.max(F.size("bounds"))).first()[0]
    if most:
        cut = cut_ranges(units, "_key", place, units_per_segment, bounds=bounds)
        large = cut_ranges(units, "_key", place, units_per_segment, bounds=bounds, large_only=True)
        kind = rows.schema[key].dataType.simpleString()
        summed = (large.select("_key", F.col("_range").cast("long").alias("block"), *order, "w", "has_text", F.xxhash64("_key", "_range").alias("_group"))
                  .repartition("_key", "block").sortWithinPartitions("_key", "block", *order).select("_key", "block", "w", "has_text", "_group")
                  .mapInArrow(_summaries(m, ["_key", "block", *_FUNCTION_NAMES]), f"_key {kind}, block long, {FUNCTION}"))
        # The functions are read on every level, up and down.
        starts, parts = _starts(summed.checkpoint(), "_key", m, most + 1)
        known = starts.checkpoint().join(parts, "_key")
        # A row for every ``units_per_segment`` units.
        cut = cut.join(F.broadcast(known) if units_per_segment >= 100_000 else known, ["_key", "_range"], "left")
    else:
        cut = units.withColumns({"_range": F.lit(-1), "state": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "n_parts": F.lit(None).cast("long")})
    ordered = (cut.withColumns({"state": F.coalesce("state", F.lit(0)), "offset": F.coalesce("offset", F.lit(0)), "_group": F.xxhash64("_key", "_range")})
               .repartition("_key", "_range").sortWithinPartitions("_key", "_range", *order))
    names = ["_key", "_range", "u", "sep", "chunk", "idx", "n_parts"]
    narrow = ordered.select("_key", "_range", "u", "sep", "w", "has_text", "state", "offset", "n_parts", "_group")
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields} | {"chunk": "long", "idx": "long", "n_parts": "long"}
    numbered = narrow.mapInArrow(_numbered(m, names), ", ".join(f"{c} {types[c]}" for c in names))
    return (numbered.groupBy("_key", "chunk").agg(F.max("n_parts").alias("n_parts"), F.array_sort(F.collect_list(F.struct("_range", "idx", "u", "sep"))).alias("_p"))
            .filter("chunk < n_parts")
            .select(F.col("_key").alias(key), F.col("chunk").cast("int").alias("part"), F.col("n_parts").cast("int").alias("n_parts"),
                    py_strip(F.array_join(F.transform("_p", lambda x: F.concat(x["u"], x["sep"])), "")).alias("chunk")))


def pack_document(rows: DataFrame, order_cols: list[str], text_col: str, max_length: int = 3000,
                  partitions: int | None = None, units_per_partition: int = UNITS_PER_SEGMENT) -> DataFrame:
    """Chunks ``(part, n_parts, chunk)`` of the one document that all ``rows`` make; see ``pack_documents``.
    ``partitions`` asks for about so many segments, whatever the size."""
    if partitions:
        units = rows.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("l")).select(F.explode(chunk_units("l", max_length)))
        units_per_partition = max(1, units.count() // partitions)
    one = rows.withColumn("_document", F.lit(0))
    return pack_documents(one, "_document", order_cols, text_col, max_length, units_per_partition).drop("_document")
