"""Approximate nearest neighbours: a forest of sorted hash-prefix arrays.

Every tree gives each vector a long bit string (signs of random projections) and keeps all
vectors sorted by it. A query descends to the longest prefixes that match its own strings, and ascends in all trees
at once, a bit at a time: the rows that share a prefix of that length with it, in any tree, are its candidates, until they
are enough. How many are enough is fitted on a sample of queries with exact answers; how many rows share a
prefix is told by a sample of each tree's strings. So dense places end at long prefixes, sparse ones at short."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, table
from estatelens.llm.textvec import mix64

TREES = 10
# Bits of a hash string; SALT_BITS more tell equal strings apart, so that they sort into several chunks.
HASH_BITS = 43
SALT_BITS = 20
# The fit: at most so many queries with exact answers, and so many rows for the quantiles of each tree.
SAMPLE_QUERIES = 256
SAMPLE_ROWS = 20_000
# Share of the sampled neighbours that the search must reach.
TARGET = 0.96
# Rows of a chunk of a sorted array, about, at any size of the table (up to CHUNK_ROWS times an eighth of the sample).
CHUNK_ROWS = 8192
# Queries that search a chunk together; with more, chunks are searched by one block of queries at a time.
QUERY_BLOCK = 50_000


def planes(trees: int, dim: int) -> np.ndarray:
    return np.random.default_rng(20).normal(size=(trees, dim + 1, HASH_BITS))


def hash_keys(x: np.ndarray, ids: np.ndarray, reach: float, hyper: np.ndarray, query: bool) -> np.ndarray:
    """The sort keys of vectors in each tree: hash string, then salt.

    Rows get one more component that brings all to one length (``reach``, that of the longest), queries a zero
    there; so the angle between them orders rows as the inner product does."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(reach * reach - (x * x).sum(1), 0))
    bits = np.einsum("nd,tdb->tnb", np.column_stack([x, extra]), hyper) > 0
    strings = (bits * (np.int64(1) << np.arange(HASH_BITS - 1, -1, -1))).sum(2)
    salt = (mix64(ids.view(np.uint64)) >> np.uint64(64 - SALT_BITS)).astype(np.int64)
    return (strings << SALT_BITS) | salt


def prefix_ranges(keys: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last sort key with the same first ``bits`` bits of the hash string as ``keys``."""
    rest = np.int64(HASH_BITS + SALT_BITS) - np.asarray(bits, np.int64)
    whole = np.left_shift(np.int64(1), np.minimum(rest, 62)) - 1
    low = np.where(rest > 62, 0, keys & ~whole)
    return low, np.where(rest > 62, np.int64(2**63 - 1), low | whole)


def met_at(sample: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``(queries, HASH_BITS + 1)``: how many sampled strings, of all trees together, share the first 0, 1, ... bits with the
    query's. ``sample`` is sorted per tree; ``keys`` are a row of queries per tree."""
    met = np.zeros((keys.shape[1], HASH_BITS + 1), np.int64)
    for t, strings in enumerate(sample):
        for bits in range(HASH_BITS + 1):
            low, last = prefix_ranges(keys[t], bits)
            met[:, bits] += np.searchsorted(strings, last, "right") - np.searchsorted(strings, low)
    return met


def ascent(sample: np.ndarray, keys: np.ndarray, want: int) -> np.ndarray:
    """The length of prefix at which each query stops: the longest with ``want`` sampled strings in all trees together."""
    return np.maximum((met_at(sample, keys) >= want).sum(1) - 1, 0)


def top(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows with the largest inner product with ``q``, ties to smaller ids, and the products."""
    rough = rows @ q
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)))
        rows, ids = rows[near], ids[near]
    exact = (rows * q).sum(1)  # the same sum for equal rows, wherever they stand
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, vec, same, norm, dim)`` of the vectors that take part: ``vec`` as doubles, ``same`` a digest of it."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = [[], [], [], [], []]
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = x.tobytes()
                same = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                for col, y in zip(out, (i, raw, same, float(np.sqrt((x * x).sum())), len(x))):
                    col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int32()))],
                                             ["vec_id", "vec", "same", "norm", "dim"])
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
            .mapInArrow(convert, "vec_id long, vec binary, same long, norm double, dim int"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()]) if len(column) else np.zeros((0, 0))


def best_per(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``(q, vec_id, score)`` per ``q``, each id once, with ``rank`` from 1."""
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["q", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_search(rows: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """``(q, vec_id, score, rank)`` of a bounded list of queries against all rows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = [(q, np.frombuffer(v, np.float64)) for q, v in queries]
        for part in batches:
            x, ids = matrix(part.column("vec")), part.column("vec_id").to_numpy()
            for q, v in ask:
                if len(ids):
                    found, score = top(x, ids, v, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q)), pa.array(found), pa.array(score)], ["q", "vec_id", "score"])
    return best_per(rows.select("vec_id", "vec").mapInArrow(scan, "q long, vec_id long, score double"), k)


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            trees: int = TREES, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (a condition on ``vec_id``) holds for, the ``k``
    other rows found with the largest inner product (double precision), ties to smaller ids.

    Vectors that are null, empty or zero, hold a null or non-finite component, or have no id take no
    part, nor do those of another length than most. Rows with equal vectors share one search, and only
    their k + 1 smallest ids can be among anyone's k nearest, so copies cost no more than that.
    A repeated id is answered once per distinct vector; other columns are ignored. An empty table gives an
    empty result; with k rows or fewer all others are returned.

    Every row is in every tree. Trees are cut into chunks of a fixed number of rows by quantiles of their keys; a query goes to all
    chunks that its ranges of prefixes reach. On vectors without structure these are many, as no short
    prefix tells near from far; on vectors with clusters they are few."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    valid = scratch.cut(usable(vectors, vec_id, embedding))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return empty
    dim = dims[0]["dim"]
    valid = valid.filter(F.col("dim") == dim)
    first = W.partitionBy("same").orderBy("vec_id")
    rows = scratch.cut(valid.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy"))
    n, reach = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    asked = valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "same")
    # One search per distinct vector; its own digest names it.
    queries = scratch.cut(rows.join(asked.select("same").distinct(), "same", "left_semi").filter(F.col("dim") == dim)
                          .groupBy("same").agg(F.min_by("vec", "vec_id").alias("vec")))
    some_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "vec").toPandas()
    some = [(r["same"], bytes(r["vec"])) for r in queries.orderBy(F.xxhash64("same"), "same").limit(SAMPLE_QUERIES).collect()]
    if not some:
        return empty
    hyper = planes(trees, dim)
    sample = np.sort(hash_keys(np.stack(some_rows["vec"].map(np.frombuffer).to_list()), some_rows["vec_id"].to_numpy(), reach, hyper, False), 1)
    truth = exact_search(rows, some, k + 1).join(rows.select("vec_id", "same", "vec"), "vec_id").select("q", "vec_id", "vec").toPandas()
    want = max(fit_want(truth, dict(some), sample, reach, hyper, target), trees * (k + 1), trees * 16)
    chunks = max(1, min(n // CHUNK_ROWS, sample.shape[1] // 8))
    blocks = -(-queries.count() // QUERY_BLOCK)
    bounds = sample[:, [i * sample.shape[1] // chunks for i in range(1, chunks)]]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            x, ids = matrix(part.column("vec")), part.column("vec_id").to_numpy()
            keys = hash_keys(x, ids, reach, hyper, False)
            for t in range(trees):
                chunk = pa.array(np.searchsorted(bounds[t], keys[t], "right").astype(np.int32))
                for block in range(blocks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), t, np.int32)), chunk, pa.array(np.full(len(ids), block, np.int32)), pa.array(keys[t]), pa.array(keys[t]),
                         pa.array(np.zeros(len(ids), bool)), part.column("vec_id"), part.column("vec")], PLANTED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                part = whole.slice(a, 1000)
                x, q = matrix(part.column("vec")), part.column("same").to_numpy()
                keys = hash_keys(x, q, reach, hyper, True)
                stop = ascent(sample, keys, want)
                block = (mix64(q.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
                for t in range(trees):
                    low, last = prefix_ranges(keys[t], stop)
                    first, end = (np.searchsorted(bounds[t], v, "right") for v in (low, last))
                    to = np.repeat(np.arange(len(q)), end - first + 1)
                    chunk = np.arange(len(to)) - np.repeat(np.cumsum(end - first + 1) - (end - first + 1), end - first + 1) + first[to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(to), t, np.int32)), pa.array(chunk.astype(np.int32)), pa.array(block[to]), pa.array(low[to]), pa.array(last[to]),
                         pa.array(np.ones(len(to), bool)), pa.array(q[to]), part.column("vec").take(pa.array(to))], PLANTED)

    def search(group: pa.Table) -> pa.Table:
        is_query_ = group.column("is_query").to_numpy()
        keys, lasts, ids, vecs = *(group.column(c).to_numpy() for c in ("key", "last", "id")), group.column("vec")
        own = np.flatnonzero(~is_query_)
        own = own[np.lexsort((ids[own], keys[own]))]
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(own):
            sorted_keys, sorted_ids = keys[own], ids[own]
            x = matrix(vecs.take(pa.array(own)))
            for i in np.flatnonzero(is_query_).tolist():
                lo, hi = int(np.searchsorted(sorted_keys, keys[i])), int(np.searchsorted(sorted_keys, lasts[i], "right"))
                if lo == hi:
                    continue
                found, score = top(x[lo:hi], sorted_ids[lo:hi], np.frombuffer(vecs[i].as_buffer(), np.float64), k + 1)
                for col, v in zip(out, (np.full(len(found), ids[i]), found, score)):
                    col.append(v)
        return pa.table([pa.array(np.concatenate(c)) for c in out], ["q", "vec_id", "score"])
    schema = "tree int, chunk int, block int, key long, last long, is_query boolean, id long, vec binary"
    planted = rows.select("vec_id", "vec").mapInArrow(plant, schema).unionByName(queries.select("same", "vec").mapInArrow(ask, schema))
    found = best_per(planted.groupBy("tree", "chunk", "block").applyInArrow(search, "q long, vec_id long, score double"), k + 1)
    # Every query of a vector gets its answers but itself.
    answers = asked.join(found.withColumnRenamed("q", "same").drop("rank"), "same").filter(F.col("vec_id") != F.col("query_id"))
    order = W.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


PLANTED = ["tree", "chunk", "block", "key", "last", "is_query", "id", "vec"]


def fit_want(truth, asked: dict[int, bytes], sample: np.ndarray, reach: float, hyper: np.ndarray, target: float) -> int:
    """How many sampled strings a query must meet so that a share ``target`` of the true neighbours of the sampled queries is
    among its candidates.

    A neighbour is met where the ascent stops at the longest prefix that it shares with the query in any tree, or at
    a shorter one; that is, if more strings are wanted than share one bit more."""
    place = {q: i for i, q in enumerate(asked)}
    ids = np.array(list(asked), np.int64)
    keys = hash_keys(np.stack([np.frombuffer(v) for v in asked.values()]), ids, reach, hyper, True)
    met = np.column_stack([met_at(sample, keys), np.zeros(len(ids), np.int64)])
    of = np.array([place[q] for q in truth["q"]])
    theirs = hash_keys(np.stack(truth["vec"].map(np.frombuffer).to_list()), truth["vec_id"].to_numpy(), reach, hyper, False)
    differ = np.frexp(((theirs ^ keys[:, of]) >> SALT_BITS).astype(np.float64))[1]  # bits from the first one that differs
    shared = HASH_BITS - differ.min(0)
    return int(np.quantile(met[of, shared + 1], target, method="higher")) + 1


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
