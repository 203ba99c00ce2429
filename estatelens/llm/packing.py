"""Best-fit packing: documents as token pieces in sequences of a fixed length, by bulk-synchronous sweeps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from estatelens.llm.common import Scratch, fresh, spread_rank, table
from estatelens.llm.textvec import slices

CAPACITY = 2048
END_OF_TEXT = 0
TOKENIZER = "byte_bpe_50k.json"


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids, as the tokenizer file at ``path`` gives them, without special tokens.

    A byte-level BPE vocabulary with the usual pattern goes through its ranks, which is four times
    as fast and gives the same ids; any other file goes through ``tokenizers`` itself."""
    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout"))
    if plain:
        # Byte-level vocabularies write a byte as a printable character: itself, or the next from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(ranked.encode_ordinary(text), np.uint32)
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY,
                 with_ids: bool = True) -> DataFrame:
    """One row per piece: the columns of ``docs`` without ``text``, then ``row`` (a number of the
    input row), ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` (little-endian 32-bit ids) and,
    ``with_ids``, the ``ids``, compressed (see ``unpacked``).

    A document is its ids and one end-of-text id. Documents over ``capacity`` are cut
    into pieces of ``capacity``; what is left over is the first piece. A null text is empty.
    Input columns named like an output column are replaced. ``row`` depends on how the input
    is split, so write the result before using it twice."""
    path = path or public_tokenizers.path(TOKENIZER)
    out = ("row", "piece", "start", "length", "ids_crc32", *(("ids",) if with_ids else ()))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    kept = [c for c in docs.columns if c.lower() not in (*out, text.lower())]
    rows = docs.select(*kept, F.col(text).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            of, cols = [], [[] for _ in out]
            for i, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                ids = np.append(encode(t or ""), np.uint32(END_OF_TEXT)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    of.append(i)
                    for col, v in zip(cols, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), packed(ids[a:b]) if with_ids else None)):
                        col.append(v)
                row += 1
            same = part.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*same.columns[:-1], *[pa.array(c, t) for c, t in zip(cols, types)]], [*kept, *out])
    schema = rows.drop("text").schema
    for name, kind in zip(out, (LongType(), IntegerType(), LongType(), LongType(), LongType(), BinaryType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(pieces, schema)


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes: two a piece where all fit, else four. Shuffles and scratch tables hold these."""
    return zlib.compress(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes(), 1)


def unpacked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids`` as an array of integers."""
    names = pieces.columns
    schema = StructType([StructField("ids", ArrayType(IntegerType())) if f.name == "ids" else f for f in pieces.schema.fields])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lengths = part.column("length").to_numpy()
                raw = [zlib.decompress(b) for b in part.column("ids").to_pylist()]
                ids = [np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4").astype(np.int32) for r, n in zip(raw, lengths.tolist())]
                ends = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([lists if c == "ids" else part.column(c) for c in names], names)
    return pieces.mapInArrow(restore, schema)


SWEPT = "item long, need int, seq long, gap int, part int, place long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches items and gaps within one range of sizes.

    From the largest size down, a gap opens a bracket and an item closes the last one open,
    which is the smallest gap left that holds it. Pairs come out with both sides; items that
    need a gap of a larger range and gaps left for smaller ranges come out numbered in order. A last
    row, without item and seq, has the numbers of both."""
    rows = pa.Table.from_batches(list(batches))
    part = TaskContext.get().partitionId()
    if not rows.num_rows:
        return
    item = rows.column("item").to_numpy()
    size, seq = rows.column("size").to_numpy(), rows.column("seq").to_numpy()
    is_item = rows.column("is_item").to_numpy()
    order = np.lexsort((np.where(is_item, item, seq), is_item, -size))
    item, size, seq, is_item = item[order], size[order], seq[order], is_item[order]
    depth = np.cumsum(np.where(is_item, -1, 1))
    floor = np.minimum(np.minimum.accumulate(depth), 0)
    alone = is_item & (np.diff(floor, prepend=0) < 0)
    level = depth - floor + is_item  # of the bracket that a row opens or closes
    rest = np.flatnonzero(~alone)
    rest = rest[np.argsort(level[rest], kind="stable")]
    pair = np.flatnonzero(is_item[rest[1:]] & ~is_item[rest[:-1]] & (level[rest[1:]] == level[rest[:-1]]))
    gaps, items = rest[pair], rest[pair + 1]
    matched = np.zeros(len(item), bool)
    matched[gaps] = matched[items] = True
    left_items, left_gaps = np.flatnonzero(is_item & ~matched), np.flatnonzero(~is_item & ~matched)

    def batch(items_, gaps_, numbered):
        n = len(items_) if items_ is not None else len(gaps_)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([
            pa.array(item[items_]) if items_ is not None else none(pa.int64()),
            pa.array(size[items_].astype(np.int32)) if items_ is not None else none(pa.int32()),
            pa.array(seq[gaps_]) if gaps_ is not None else none(pa.int64()),
            pa.array(size[gaps_].astype(np.int32)) if gaps_ is not None else none(pa.int32()),
            pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n)) if numbered else none(pa.int64())],
            ["item", "need", "seq", "gap", "part", "place"])
    yield batch(items, gaps, False)
    yield batch(left_items, None, True)
    yield batch(None, left_gaps, True)
    yield pa.RecordBatch.from_pydict({"item": [None], "need": [len(left_items)], "seq": [None], "gap": [len(left_gaps)], "part": [part], "place": [None]},
                                     schema=pa.schema([("item", pa.int64()), ("need", pa.int32()), ("seq", pa.int64()), ("gap", pa.int32()),
                                                       ("part", pa.int32()), ("place", pa.int64())]))


def settle(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Brackets across ranges. ``left``: ``(part, items, gaps)`` of each range, largest sizes first.
    Gives ``(part, first, end, gap_part, gap_last)``: items numbered ``first`` to ``end`` of ``part`` take the gaps of
    ``gap_part`` from ``gap_last`` downwards. One row per range comes in, at most two go out."""
    stack, out = [], []
    for part, items, gaps in left:
        at = 0
        while at < items and stack:
            p, n = stack.pop()
            k = min(n, items - at)
            out.append((part, at, at + k, p, n - 1))
            at += k
            if n > k:
                stack.append((p, n - k))
        if gaps:
            stack.append((part, gaps))
    return out


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(item, seq, offset)`` for every row ``(item long, need int)`` of ``items``: sequences of
    ``capacity`` in which items stand without gaps from 0.

    Items over half of the capacity open a sequence each, and as many empty ones are opened as the
    room for the others then lacks. Each round range-sorts open items and gaps by size,
    sweeps every range for the smallest gap that holds each item (a gap takes one item a round;
    the larger item, then the smaller number, comes first), settles what is left across
    ranges by its rank, and updates the gaps. Items larger than every gap left get new
    sequences. Offsets follow at the end, by item number. It ends when no item is left;
    each round places the largest item left at least.

    Where tiny items are many more than sequences, most of them enter as bundles (see
    ``bundles``), so the rounds stay few.

    ``items`` needs distinct numbers (item >= 0) and needs from 1 to ``capacity``, and is read more
    than once. Equal needs are told apart by number; an empty table gives an empty result."""
    spark = items.sparkSession
    scratch = Scratch(spark)
    total, tiny = items.agg(F.sum("need"), F.count_if(F.col("need") * 32 <= capacity)).first()
    sequences = -(-(total or 0) // capacity)
    bundled = None
    if tiny and tiny > 4 * sequences:
        bundled = scratch.cut(bundles(items.filter(F.col("need") * 32 <= capacity), capacity, sequences))
        heads = bundled.groupBy("bundle").agg(F.min("item").alias("item"), F.sum("need").cast("int").alias("need"))
        items = scratch.cut(items.filter(F.col("need") * 32 > capacity).unionByName(heads.drop("bundle")))
    opened = 0
    none_long, none_int = F.lit(None).cast("long"), F.lit(None).cast("int")
    alone = F.col("need") * 2 > capacity
    state = scratch.cut(items.select("item", "need", F.when(alone, F.col("item")).otherwise(none_long).alias("seq"),
                                     F.when(alone, capacity).otherwise(none_int).alias("gap")))
    done = []
    while True:
        placed = state.filter("item is not null and seq is not null")
        done.append(placed.select("item", "seq", "need"))
        gaps = state.filter("seq is not null").select("seq", (F.col("gap") - F.coalesce("need", F.lit(0))).alias("size")).filter("size > 0")
        todo = state.filter("item is not null and seq is null")
        largest, lack, room, widest = state.agg(*map(F.expr, (
            "max(if(seq is null, need, 0))", "sum(if(seq is null, need, 0))", "sum(if(seq is not null, gap - coalesce(need, 0), 0))",
            "coalesce(max(if(seq is not null, gap - coalesce(need, 0), 0)), 0)"))).first()
        if not largest:
            break
        if len(done) > 1:
            lack, room = todo.filter(F.col("need") > widest).agg(F.sum("need")).first()[0] if largest > widest else 0, 0
        new = max(0, -(-(lack - room) // capacity))
        # Later, a sequence opens as several gaps, so that it takes several of the items left in one round.
        parts = 1 if len(done) == 1 else max(1, capacity // largest)
        fresh_gaps = spark.range(opened * parts, (opened + new) * parts).select(
            (-1 - F.floor(F.col("id") / parts)).cast("long").alias("seq"), F.lit(capacity // parts).alias("size"))
        opened += new
        both = (todo.select("item", F.lit(0).cast("long").alias("seq"), F.col("need").alias("size"), F.lit(True).alias("is_item"))
                .unionByName(gaps.unionByName(fresh_gaps).select(F.lit(-1).cast("long").alias("item"), "seq", "size", F.lit(False).alias("is_item"))))
        swept = scratch.cut(both.repartitionByRange(F.desc("size"), "is_item", "item", "seq").mapInArrow(sweep, SWEPT))
        counts = swept.filter("item is null and seq is null").select("part", "need", "gap").collect()  # one row per range
        moves = spark.createDataFrame(settle(sorted(map(tuple, counts))), "part int, first long, end long, gap_part int, gap_last long")
        left_items = swept.filter("place is not null and item is not null").select("item", "need", "part", "place")
        to = (F.col("l.part") == F.col("m.part")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))
        aimed = left_items.alias("l").join(F.broadcast(moves).alias("m"), to, "left").select(
            "item", "need", F.col("gap_part").alias("part"), (F.col("gap_last") - (F.col("place") - F.col("first"))).alias("place"))
        spare = swept.filter("place is not null and seq is not null").select("seq", "gap", "part", "place")
        state = scratch.cut(
            swept.filter("item is not null and seq is not null").select("item", "need", "seq", "gap")
            .unionByName(aimed.filter("part is not null").join(spare, ["part", "place"], "full").select("item", "need", "seq", "gap"))
            # Items that no gap holds have no key to meet on.
            .unionByName(aimed.filter("part is null").select("item", "need", none_long.alias("seq"), none_int.alias("gap"))))
        scratch.drop(swept)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    before = W.partitionBy("seq").orderBy("item").rowsBetween(W.unboundedPreceding, -1)
    result = result.select("item", "seq", F.coalesce(F.sum("need").over(before), F.lit(0)).cast("int").alias("offset"))
    if bundled is None:
        return result
    # A bundle stands under its least item; its other items follow it.
    first = bundled.groupBy("bundle").agg(F.min("item").alias("head"))
    inside = bundled.join(first, "bundle").select("head", F.col("item").alias("member"), "before")
    return (result.join(inside, F.col("item") == F.col("head"), "left")
            .select(F.coalesce("member", "item").alias("item"), "seq", (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset")))


def bundles(tiny: DataFrame, capacity: int, sequences: int) -> DataFrame:
    """``(item, need, bundle, before)``: items of one size bundled up to a sixteenth of the capacity, ``before`` being
    an item's place in its bundle. Of each size, one item per sequence stays a bundle of its own, to fill small gaps."""
    ranked = spread_rank(tiny, ["need"], F.col("item"), [F.col("item")], "rank", few_groups=True)
    many = F.floor(F.lit(capacity // 16) / F.col("need"))
    rest = F.col("rank") - sequences
    single = (rest < 0) | (many < 2)
    return ranked.select("item", "need", F.struct("need", single.alias("single"), F.when(single, F.col("rank")).otherwise(F.floor(rest / many)).alias("number")).alias("bundle"),
                         F.when(single, 0).otherwise(rest % many * F.col("need")).cast("int").alias("before"))


def pack(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents (see ``token_pieces``) with ``sequence_id`` and ``offset``.

    Every row of ``docs`` is a document of its own, repeated rows too; an empty or null text is
    one end-of-text id; other columns are kept. An empty table gives an empty result."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("sequence_id", "offset")])
    scratch = Scratch(docs.sparkSession)
    numbered = token_pieces(docs, text, path, capacity, with_ids)
    item, = fresh(numbered, "_item")
    # Written once, so that a piece keeps its number.
    numbered = scratch.cut(numbered.withColumn(item, F.monotonically_increasing_id()))
    where = best_fit(numbered.select(F.col(item).alias("item"), F.col("length").cast("int").alias("need")), capacity)
    where = where.select(F.col("item").alias(item), F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    out = numbered.join(where, item).drop(item, "row")
    return unpacked(out) if with_ids else out


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
