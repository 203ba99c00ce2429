"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, fresh, table

# Words of a block; quotas count blocks, so a source is met within about half a block.
BLOCK_WORDS = 32
# A shard (one seeded slice of the corpus) holds about this many documents of all sources together.
DOCS_PER_SHARD = 4096
# Up to so many sources, one short row each, are sent to all executors.
BROADCAST_SOURCES = 100_000
# Fixed values of the registered query: weights by source in code point order, share of all words, repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null counts as no word."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``target`` for each row ``(key, source_size)`` of ``sources``: ``share`` of all words by
    weight, at most ``max_repeats`` times a source's size, the excess reshared by weight.

    Where every source is full, targets stop there. With factor ``f = max_repeats * size /
    weight`` ascending, the sources that end up full come first: source i is full if giving
    all that is left after the fuller ones by weight would put it over its limit."""
    keyed = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.row_number().over(W.orderBy(F.col("key").asc_nulls_last())) - 1).cast("int") % len(weights) + 1))
    limit = F.col("source_size") * max_repeats
    by_factor = W.orderBy(F.col("limit") / F.col("weight"), F.col("key").asc_nulls_last())
    everyone = W.partitionBy()
    before = by_factor.rowsBetween(W.unboundedPreceding, -1)
    staged = (keyed.withColumn("limit", limit)
              .withColumn("total", F.sum("source_size").over(everyone) * share)
              .withColumn("full_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
              .withColumn("weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("by_weight", (F.col("total") - F.col("full_before")) * F.col("weight") / F.col("weight_left"))
              .withColumn("is_full", F.col("by_weight") >= F.col("limit")))
    # The first source that isn't full fixes the rate for itself and all after it.
    rate = F.min(F.when(~F.col("is_full"), F.struct(F.col("limit") / F.col("weight"), F.col("key"),
                                                   F.col("by_weight") / F.col("weight")).alias("s"))).over(everyone)
    return (staged.withColumn("rate", rate["col3"])
            .withColumn("target", F.least("limit", F.coalesce(F.col("rate") * F.col("weight"), F.col("limit"))))
            .select(*sources.columns, "target"))


def sainte_lague(parts: DataFrame, group: list[str], key: list[str], share: Column, seats: Column) -> DataFrame:
    """``quota`` for each row of ``parts``: ``seats`` of its group dealt to the highest quotients share / (2k + 1).

    Rounding share * seats / total gives all quotients above one threshold. Seats still
    missing (or too many) are settled by ranking the quotients next to it. Moving the
    threshold until they are settled changes the divisor by at most n / (2 * seats), so a part
    moves by at most exact * n / (2 * seats) + 1 seats: the ranked quotients are linear in n."""
    total, n, exact, base, odd, k, pos, moved = fresh(
        parts, "_total", "_n", "_exact", "_base", "_odd", "_k", "_pos", "_moved")
    g = W.partitionBy(*group)
    rounded = (parts.withColumn(total, F.sum(share).over(g)).withColumn(n, F.count(F.lit(1)).over(g))
               .withColumn(exact, F.when(F.col(total) > 0, share * seats / F.col(total)).otherwise(0.0))
               .withColumn(base, F.floor(F.col(exact) + 0.5)))
    gap = rounded.withColumn(odd, seats - F.sum(base).over(g)).filter(F.col(odd) != 0)
    most = F.least(F.abs(odd), F.floor(F.col(exact) * F.col(n) / (seats * 2)) + 2)
    # odd > 0: that many of the next quotients get a seat; odd < 0: that many of the last lose theirs.
    cand = (gap.withColumn(k, F.explode(F.sequence(F.lit(1), most.cast("int"))))
            .withColumn(k, F.when(F.col(odd) > 0, F.col(base) + F.col(k) - 1).otherwise(F.col(base) - F.col(k)))
            .filter(F.col(k) >= 0))
    quotient = share / (F.col(k) * 2 + 1)
    order = F.when(F.col(odd) > 0, -quotient).otherwise(quotient)
    settled = (cand.withColumn(pos, F.row_number().over(g.orderBy(order, *key)))
               .filter(F.col(pos) <= F.abs(odd))
               .groupBy(*group, *key).agg(F.sum(F.signum(odd)).cast("long").alias(moved)))
    joined = rounded.join(settled, [*group, *key], "left")
    return joined.withColumn("quota", F.col(base) + F.coalesce(moved, F.lit(0))).drop(total, n, exact, base, moved)


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of its text."""
    return docs.withColumn("size", word_count(F.col(text)))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE, max_repeats: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
        docs_per_shard: int = DOCS_PER_SHARD, seed: str = SEED, measured: DataFrame | None = None) -> DataFrame:
    """``docs`` (with ``size``, see ``with_sizes``) with ``source_size``, ``target`` and ``taken``, the
    words that the mix takes of a document, repeats counted.

    All words of the mix are equal blocks of ``block_words``; Sainte-Lague deals them to the
    sources by target. Each source is cut into shards by a seeded hash of the id, and its
    blocks are dealt to its shards by their words, so each (source, shard) cell has an integer quota.
    Within a cell the documents stand in seeded order; the cell's words are taken wholly as
    often as the quota allows, and the blocks that remain are a run from a seeded block
    on, around the end. ``taken`` is the overlap of a document with that, so no document
    exceeds ``max_repeats`` times its size.

    Sources are ordered by code point, null last (null is a source of its own), and take
    the weights in turn. Documents of size 0 (null or blank text) are never taken. Repeated
    rows are rows of their own. Input columns named like an output column are replaced; others
    are kept. Empty tables give empty results. Quotas are counted from ``measured``, a written table with
    the id, source and size of the same rows, or else from ``docs``, which should then be a written table."""
    out = ("source_size", "target", "taken")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out])
    shard, order, key, cell, quota, before, full, rest, start, n_shards, seats = fresh(
        docs, "_shard", "_order", "_key", "_cell", "_quota", "_before", "_full", "_rest", "_start", "_n_shards", "_seats")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string")))
    # Sources as strings that are never null, so that they can be joined; the first character tells null apart.
    named = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    keyed = docs.withColumn(key, named).withColumn(order, digest)
    counted = keyed if measured is None else measured.withColumn(key, named).withColumn(order, digest)
    counts = counted.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    few = counts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    goal = targets(counts, weights, share, max_repeats)
    house = F.floor(F.sum("target").over(W.partitionBy()) / block_words + 0.5)
    goal = sainte_lague(goal.withColumn("house", house).withColumn("all", F.lit(1)), ["all"], ["key"], F.col("target"), F.col("house"))
    goal = goal.select(F.col("key").alias(key), "source_size", "target", F.col("quota").alias(seats),
                       F.ceil(F.col("n") / docs_per_shard).alias(n_shards))

    def placed_in_shards(rows: DataFrame) -> DataFrame:
        # A source may hold most rows: don't shuffle by source unless there are too many sources to send around.
        return rows.join(F.broadcast(goal) if few else goal, key).withColumn(shard, F.shiftright(
            F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.col(n_shards), 32))
    placed = placed_in_shards(keyed)
    cells = (placed if measured is None else placed_in_shards(counted)).groupBy(key, shard).agg(F.sum("size").alias(cell), F.first(seats).alias(seats)).filter(F.col(cell) > 0)
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.col(shard).cast("string"))), 1, 8), 16, 10).cast("long")
    quotas = (sainte_lague(cells, [key], [shard], F.col(cell), F.col(seats))
              .withColumn(quota, F.least(F.col("quota") * block_words, F.floor(F.col(cell) * max_repeats)))
              .withColumn(full, F.floor(F.col(quota) / F.col(cell)))
              .withColumn(rest, F.col(quota) - F.col(full) * F.col(cell))
              .withColumn(start, (pick % F.ceil(F.col(cell) / block_words)) * block_words)
              .select(key, shard, cell, full, rest, start))
    runs = W.partitionBy(key, shard).orderBy(order, doc_id, "size").rowsBetween(W.unboundedPreceding, -1)
    at = placed.withColumn(before, F.coalesce(F.sum("size").over(runs), F.lit(0))).join(quotas, [key, shard], "left")
    a, b, end = F.col(before), F.col(before) + F.col("size"), F.col(start) + F.col(rest)

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(b, hi) - F.greatest(a, lo), F.lit(0))
    part = overlap(F.col(start), F.least(end, F.col(cell))) + overlap(F.lit(0), end - F.col(cell))
    taken = F.coalesce(F.col(full) * F.col("size") + part, F.lit(0)).cast("long")
    return at.select(*docs.columns, "source_size", "target", taken.alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mix(Scratch(spark).cut(docs)).drop("source")


def _sql_quotas(name: str, parts: str, group: str, key: str, share: str, seats: str) -> str:
    """CTEs that end in ``name``: the rows of ``parts`` with ``quota``, their share of the group's seats by highest quotients."""
    return f"""{name}_exact AS (
  SELECT *, sum({share}) OVER g AS total, count(*) OVER g AS parts_n,
         CASE WHEN sum({share}) OVER g > 0 THEN {share} * {seats} / sum({share}) OVER g ELSE 0.0 END AS exact
  FROM {parts} WINDOW g AS (PARTITION BY {group})),
{name}_base AS (SELECT *, floor(exact + 0.5)::BIGINT AS base FROM {name}_exact),
{name}_odd AS (SELECT *, ({seats} - sum(base) OVER (PARTITION BY {group}))::BIGINT AS odd FROM {name}_base),
{name}_cand AS (
  SELECT {group}, {key}, odd, {share} / (k * 2 + 1) AS quotient FROM (
    SELECT *, unnest(CASE WHEN odd > 0 THEN range(base, base + odd) ELSE range(greatest(base + odd, 0), base) END) AS k
    FROM {name}_odd WHERE odd <> 0)),
{name}_moved AS (
  SELECT {group}, {key}, sum(sign(odd))::BIGINT AS moved FROM (
    SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN odd > 0 THEN -quotient ELSE quotient END, {key}) AS pos FROM {name}_cand)
  WHERE pos <= abs(odd) GROUP BY {group}, {key}),
{name} AS (SELECT {name}_odd.*, base + coalesce(moved, 0) AS quota FROM {name}_odd LEFT JOIN {name}_moved USING ({group}, {key}))"""


def _sql_hash(text: str) -> str:
    return f"('0x' || substring(md5({text}), 1, 8))::BIGINT"


_PAST = "start + quota_words - full_times * cell - cell"

OP10_SQL = f"""
WITH docs AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5('{SEED}:' || doc_id::VARCHAR) AS place FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS source_size, count(*) AS n, 1 AS every FROM docs GROUP BY key),
weighed AS (
  SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)}) + 1] AS weight,
         source_size * {MAX_REPEATS}::DOUBLE AS most FROM sources),
filled AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate
  FROM weighed WINDOW b AS (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT key, source_size, n, every, least(most, coalesce(
    (SELECT arg_min(rate, (most / weight, key)) FROM filled WHERE rate * weight < most) * weight, most)) AS target FROM filled),
housed AS (SELECT *, floor(sum(target) OVER () / {BLOCK_WORDS} + 0.5)::BIGINT AS house FROM goals),
{_sql_quotas("shares", "housed", "every", "key", "target", "house")},
placed AS (
  SELECT docs.*, source_size, target, quota AS seats, ({_sql_hash("docs.doc_id::VARCHAR").replace("md5(docs.doc_id::VARCHAR)", "place")} * ceil(n / {DOCS_PER_SHARD}.0)::BIGINT) >> 32 AS shard
  FROM docs JOIN shares USING (key)),
cells AS (SELECT key, shard, sum(size)::BIGINT AS cell, any_value(seats) AS seats FROM placed GROUP BY key, shard HAVING sum(size) > 0),
{_sql_quotas("dealt", "cells", "key", "shard", "cell", "seats")},
picked AS (
  SELECT key, shard, cell, least(quota * {BLOCK_WORDS}, floor(cell * {MAX_REPEATS})::BIGINT) AS quota_words,
         ({_sql_hash(f"'{SEED}:' || key || ':' || shard")} % ceil(cell / {BLOCK_WORDS}.0)::BIGINT) * {BLOCK_WORDS} AS start FROM dealt),
runs AS (SELECT *, quota_words // cell AS full_times FROM picked),
stood AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(full_times * size
    + greatest(least(a + size, least(start + quota_words - full_times * cell, cell)) - greatest(a, start), 0)
    + greatest(least(a + size, {_PAST}) - a, 0), 0)::BIGINT AS taken
FROM stood LEFT JOIN runs USING (key, shard)"""
