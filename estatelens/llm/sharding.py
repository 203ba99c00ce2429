"""Sharding: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, fresh, spread_rank, table

VIRTUAL_NODES = 64
SHARDS = 40
RING = 2 ** 32


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes, clockwise."""
    return sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:8], 16), s)
                  for s in range(shards) for v in range(virtual_nodes))


def grid(positions: list[int], bits: int) -> list[tuple[int, int, int, int]]:
    """``(cell, lo, hi, arc)``: places ``lo`` to ``hi`` of a grid cell (2 ** ``bits`` places) belong to ``arc``.
    Arc i ends at position i; places past the last position belong to arc 0. Of nodes at
    one position the first counts."""
    out, lo = [], 0
    spans = [(p, i) for i, p in enumerate(positions) if not i or p != positions[i - 1]]
    for hi, arc in [*spans, (RING - 1, 0)]:
        while lo <= hi:
            end = min(hi, (((lo >> bits) + 1) << bits) - 1)
            out.append((lo >> bits, lo, end, arc))
            lo = end + 1
    return out


def deal_clockwise(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, first, end, shard, slot)``: the rows of ``arc`` ranked ``first`` to ``end`` go to
    ``shard``, from ``slot`` on. ``counts`` has the rows of each arc, ``owners`` its shard, ``room`` what a
    shard may hold; together the shards hold all rows.

    All arcs fill their own shard first, in ring order; what doesn't fit moves clockwise, arc by arc,
    to the next shard with room. Its input and work are bounded by the number of virtual nodes, not by rows."""
    used, out, over = [0] * len(room), [], []
    for arc, (n, s) in enumerate(zip(counts, owners)):
        fits = min(n, room[s] - used[s])
        if fits:
            out.append((arc, 0, fits, s, used[s]))
            used[s] += fits
        if n > fits:
            over.append((arc, fits, n))
    for arc, first, n in over:
        at = arc
        while first < n:
            at = (at + 1) % len(owners)
            s = owners[at]
            fits = min(n - first, room[s] - used[s])
            if fits:
                out.append((arc, first, first + fits, s, used[s]))
                used[s] += fits
                first += fits
    return out


def shard_rows(rows: DataFrame, key: str, order: list[str], shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES,
               rows_per_task: int = 1_000_000) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard); counts of
    rows per shard are at most one apart.

    A row's place on the ring is a hash of ``key``, and it belongs to the next virtual node
    clockwise. A shard holds at most its even share of the rows; rows over that continue
    clockwise to the next shard with room. So rows with equal keys share a shard unless it is
    full, and more virtual nodes or shards move few rows.

    Which rows of an arc stay is decided by their rank by place on the ring, then ``order``;
    a key with a third of all rows is ranked in parts and continues over as many shards as it needs.
    Null keys hash like an empty string. Repeated rows are rows of their own. Empty tables give
    empty results. Input columns named ``shard`` or ``slot`` are replaced. ``rows`` is read
    more than once: pass a written table."""
    spark = rows.sparkSession
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "slot")])
    place, cell, arc, rank, lo, hi, base = fresh(rows, "_place", "_cell", "_arc", "_rank", "_lo", "_hi", "_base")
    nodes = ring(shards, virtual_nodes)
    owners = [s for _, s in nodes]
    on_ring = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    # As many grid cells as nodes; each lists the arcs that it meets, so the table is bounded by nodes + cells.
    bits = 32 - max(1, len(nodes).bit_length())
    cells = spark.createDataFrame(grid([p for p, _ in nodes], bits), f"{cell} long, {lo} long, {hi} long, {arc} int")
    at = (rows.withColumn(place, on_ring).withColumn(cell, F.shiftright(place, bits)).join(F.broadcast(cells), cell)
          .filter((F.col(place) >= F.col(lo)) & (F.col(place) <= F.col(hi))).drop(cell, lo, hi))
    counts = {r[arc]: r["count"] for r in at.groupBy(arc).count().collect()}  # at most one row per virtual node
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    segments = spark.createDataFrame(deal_clockwise([counts.get(i, 0) for i in range(len(nodes))], owners, room),
                                     f"{arc} int, {lo} long, {hi} long, shard int, {base} long")
    ids = [F.col(c) for c in order]
    ranked = spread_rank(at, [arc], F.xxhash64(*ids).bitwiseAND(2 ** 62 - 1), [F.col(place), *ids], rank, rows_per_task, few_groups=True)
    return (ranked.join(F.broadcast(segments), arc).filter((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
            .select(*rows.columns, "shard", (F.col(base) + F.col(rank) - F.col(lo)).alias("slot")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    placed = shard_rows(Scratch(spark).cut(rows), "group", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
