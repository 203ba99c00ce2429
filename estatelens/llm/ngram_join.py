"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

All sizes below follow from the threshold: a set of n shingles needs an overlap of at least
need(n) with any partner, whatever the partner's size.

1. Every text's shingle set is hashed; the lists of its first shingles in hash order, a bounded
   share of it, are counted. Sets whose lists are too often their own are done.
2. The lists of all shingles of the remaining sets are counted. Shingles in one set only leave the
   sets; sets with less than need(n) shingles left are done.
3. What is left of a set beyond need(n) - 1 shingles, rarest first, holds a shingle of any
   partner. Sets that share such a shingle form a block.
4. In a block, a set's lists are merged (the short ones) and probed (the long ones)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, fresh, spread_rank, table
from estatelens.llm.components import components
from estatelens.llm.textvec import keys64, mix64, slices, word_hashes

WORDS = 5
# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
# Sets of a block that one task holds; larger blocks are first thinned out, then cut into pairs of slices.
BLOCK_SETS = 4000
# Postings that a task gathers before it sends them on.
FLUSH = 1_000_000

POSTING = np.dtype([("token", "<u4"), ("node", "<i8")])
FULL_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4")])
SHARED = np.dtype([("node", "<i8"), ("token", "<u8"), ("df", "<u4"), ("n", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("lo", "<i8"), ("hi", "<i8"), ("n", "<i8")])
_KEYS = keys64(WORDS + 1, 77)


def need(n, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any set that it links to."""
    return (n * percent + 99) // 100


def spare(n):
    """How many shared shingles the first pass asks of a set of ``n`` and a partner at least as large."""
    return 1 + n // 10


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    w, first, _ = word_hashes(column)
    sizes = np.diff(first)
    k = max(len(w) - words + 1, 0)
    h = np.zeros(k, np.uint64)
    for i in range(words):
        h += w[i:i + k] * _KEYS[i]
    h = mix64(h)
    out = []
    for a, n in zip(first[:-1].tolist(), sizes.tolist()):
        if n >= words:
            out.append(np.unique(h[a:a + n - words + 1]))
        elif n:
            # The number of words takes part, so that this is no shingle of a longer text.
            out.append(mix64((w[a:a + n] * _KEYS[:n]).sum(keepdims=True, dtype=np.uint64) + _KEYS[words:] * np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    ends = np.cumsum([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    both = []
    for salt in (0x5BD1E995, 0x27D4EB2F165667C5):
        run = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix64(tokens ^ np.uint64(salt)), dtype=np.uint64, out=run[1:])
        both.append(mix64(np.diff(run[np.r_[0, ends]]) + np.uint64(salt)).view(np.int64))
    return both[0], both[1]


def first_of_each(digest: np.ndarray, seen: set[int]) -> np.ndarray:
    """The rows whose digest a task meets for the first time."""
    new = []
    for i, d in enumerate(digest.tolist()):
        if d not in seen:
            seen.add(d)
            new.append(i)
    return np.array(new, np.int64)


def by_bucket(rows: np.ndarray, bucket: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of a fixed layout as one binary value per bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*at[1:].tolist(), len(rows)]
    data = [rows[a:b].tobytes() for a, b in zip(at.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)),
                                       pa.array(data, pa.binary())], ["bucket", "kind", "data"])


BUCKETED = "bucket int, kind int, data binary"


def unpack(rows: pa.Table, layout: np.dtype, kind: int = 0) -> np.ndarray:
    got = [np.frombuffer(d, layout) for k, d in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist()) if k == kind]
    return np.concatenate(got) if got else np.zeros(0, layout)


def shared_postings(posts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct postings whose list has two sets or more, and the length of that list."""
    posts = posts[np.lexsort((posts["node"], posts["token"]))]
    new = np.ones(len(posts), bool)
    new[1:] = (posts["token"][1:] != posts["token"][:-1]) | (posts["node"][1:] != posts["node"][:-1])
    posts = posts[new]
    at = np.flatnonzero(np.r_[True, posts["token"][1:] != posts["token"][:-1]]) if len(posts) else np.zeros(0, np.int64)
    df = np.diff(np.r_[at, len(posts)])
    df = np.repeat(df, df)
    return posts[df > 1], df[df > 1]


def first_pass(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``(kind, doc_id, lo, hi, n, shared)``: a row per document (kind 1), and for each set how many of its
    first shingles other sets also have among their first (kind 0; ``lo`` and ``shared``)."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, held, seen = [], 0, set()

        def flush():
            rows = np.concatenate([p[1] for p in posts])
            return by_bucket(rows, np.concatenate([p[0] for p in posts]))
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"))
            lo, hi = digests(sets)
            n = np.array([len(s) for s in sets], np.int64)
            docs_ = np.zeros(len(sets), DOC)
            ids = part.column("doc_id")
            docs_["doc_id"], docs_["known"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            docs_["lo"], docs_["hi"], docs_["n"] = lo, hi, n
            yield by_bucket(docs_, (mix64(docs_["doc_id"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), 1)
            take = np.minimum(n, n - need(n, percent) + spare(n))
            once = first_of_each(lo, seen)  # copies in one task count once
            once = once[n[once] > 0]
            if not len(once):
                continue
            tokens = np.concatenate([sets[i][:take[i]] for i in once])
            rows = np.zeros(len(tokens), POSTING)
            rows["token"], rows["node"] = tokens.astype(np.uint32), np.repeat(lo[once], take[once])
            posts.append((((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), rows))
            held += len(rows)
            if held > FLUSH:
                yield flush()
                posts, held = [], 0
        if posts:
            yield flush()

    def count(rows: pa.Table) -> pa.Table:
        docs_ = unpack(rows, DOC, 1)
        posts, _ = shared_postings(unpack(rows, POSTING))
        node, times = np.unique(posts["node"], return_counts=True)
        a, b = len(docs_), len(node)
        pad = lambda x, t: pa.concat_arrays([x, pa.nulls(b, t)])
        return pa.table({
            "kind": pa.array(np.repeat(np.array([1, 0], np.int32), [a, b])),
            "doc_id": pad(pa.array(docs_["doc_id"], mask=docs_["known"] == 0), pa.int64()),
            "lo": pa.array(np.concatenate([docs_["lo"], node])),
            "hi": pad(pa.array(docs_["hi"]), pa.int64()), "n": pad(pa.array(docs_["n"]), pa.int64()),
            "shared": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(times.astype(np.int64))])})
    return (docs.mapInArrow(prefixes, BUCKETED).groupBy("bucket")
            .applyInArrow(count, "kind int, doc_id long, lo long, hi long, n long, shared long"))


def second_pass(docs: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``(node, n, tokens, first)`` of the sets that have need(n) shingles in common with others: these
    shingles, sorted, and the rarest of them that any partner must share one of."""
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, held, seen = [], 0, set()

        def flush():
            rows = np.concatenate(posts)
            return by_bucket(rows, ((rows["token"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"))
            lo, _ = digests(sets)
            once = first_of_each(lo, seen)
            if not len(once):
                continue
            tokens = np.concatenate([sets[i] for i in once])
            n = np.array([len(sets[i]) for i in once])
            rows = np.zeros(len(tokens), FULL_POSTING)
            rows["token"], rows["node"], rows["n"] = tokens, np.repeat(lo[once], n), np.repeat(n, n)
            posts.append(rows)
            held += len(rows)
            if held > FLUSH:
                yield flush()
                posts, held = [], 0
        if posts:
            yield flush()

    def lists(rows: pa.Table) -> pa.Table:
        posts, df = shared_postings(unpack(rows, FULL_POSTING))
        out = np.zeros(len(posts), SHARED)
        for c in ("node", "token", "n"):
            out[c] = posts[c]
        out["df"] = df
        return pa.Table.from_batches([by_bucket(out, (out["node"].view(np.uint64) % np.uint64(buckets)).astype(np.int64))])

    def keep(rows: pa.Table) -> pa.Table:
        own = unpack(rows, SHARED)
        own = own[np.lexsort((own["token"], own["df"], own["node"]))]
        at = np.flatnonzero(np.diff(own["node"], prepend=own["node"][:1] ^ 1)) if len(own) else np.zeros(0, np.int64)
        m = np.diff(np.r_[at, len(own)])
        n = own["n"][at].astype(np.int64)
        ok = m >= need(n, percent)
        out = [[], [], [], []]
        for a, k, size in zip(at[ok].tolist(), m[ok].tolist(), n[ok].tolist()):
            tokens = own["token"][a:a + k]
            for col, v in zip(out, (own["node"][a], size, np.sort(tokens).tobytes(), tokens[:k - need(size, percent) + 1].tobytes())):
                col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        ["node", "n", "tokens", "first"])
    shared = docs.select("text").mapInArrow(postings, BUCKETED).groupBy("bucket").applyInArrow(lists, BUCKETED)
    return shared.groupBy("bucket").applyInArrow(keep, "node long, n long, tokens binary, first binary")


def block_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """``(a, b)``: edges that join the sets with a shingle in common among their ``first``; a forest per bucket of shingles."""
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            firsts = [np.frombuffer(f, "<u8") for f in part.column("first").to_pylist()]
            if not firsts:
                continue
            tokens = np.concatenate(firsts)
            rows = np.zeros(len(tokens), np.dtype([("token", "<u8"), ("node", "<i8")]))
            rows["token"], rows["node"] = tokens, np.repeat(part.column("node").to_numpy(), [len(f) for f in firsts])
            yield by_bucket(rows, (tokens % np.uint64(buckets)).astype(np.int64))

    def forest(rows: pa.Table) -> pa.Table:
        posts, _ = shared_postings(unpack(rows, np.dtype([("token", "<u8"), ("node", "<i8")])))
        at = np.flatnonzero(np.r_[True, posts["token"][1:] != posts["token"][:-1]]) if len(posts) else np.zeros(0, np.int64)
        head = np.repeat(posts["node"][at], np.diff(np.r_[at, len(posts)]))
        pairs = np.unique(np.stack([posts["node"], head], 1)[posts["node"] != head], axis=0) if len(posts) else np.zeros((0, 2), np.int64)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x
        out = []
        for a, b in pairs.tolist():
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return pa.table([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])
    return sets.select("node", "first").mapInArrow(postings, BUCKETED).groupBy("bucket").applyInArrow(forest, "a long, b long")


def links_in_block(node: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least node that each set of a block reaches by links; with two sides, by links across them.

    Sets are taken by size. A set looks for linked sets that are no larger (so its overlap is at least
    need(n)) and that it isn't joined to yet: of its inverted lists, the short ones are merged
    and counted, and sets that could still reach need(n) are probed in the long ones."""
    order = np.lexsort((node, n))
    node, n, side, sets = node[order], n[order], side[order], [sets[i] for i in order]
    m = len(node)
    comp = np.arange(m)
    members = {i: [i] for i in range(m)}
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    keys = np.sort(ids.astype(np.int64) * m + owner)  # the inverted lists, one after the other
    ends = np.cumsum([len(s) for s in sets])

    def linked(x: int, y, overlap):
        return 100 * overlap >= percent * (n[x] + n[y] - overlap)

    def join(x: int, y: int) -> None:
        a, b = sorted((int(comp[x]), int(comp[y])), key=lambda c: len(members[c]))
        comp[members[a]] = b
        members[b] += members.pop(a)

    for x in range(1, m):
        t = need(int(n[x]), percent)
        lo = int(np.searchsorted(n, t))
        if lo >= x:
            continue
        mine = ids[ends[x] - len(sets[x]):ends[x]].astype(np.int64) * m
        a, b = np.searchsorted(keys, mine + lo), np.searchsorted(keys, mine + x)
        size = b - a
        by_size = np.argsort(size, kind="stable")
        longest = max(int(size.max()), 2)
        skip = min(t - 1, int(t / (0.01 * np.log2(longest) + 1)), len(mine) - 1)
        short, long_ = by_size[:len(mine) - skip], by_size[len(mine) - skip:]
        size = size[short]
        total = int(size.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(a[short] - (np.cumsum(size) - size), size)
        counts = np.bincount(keys[at] - np.repeat(mine[short], size) - lo, minlength=x - lo)
        cand = np.flatnonzero(counts >= t - skip) + lo
        cand = cand[(comp[cand] != comp[x]) & ((side[cand] != side[x]) | (side[x] < 0))]
        cand = cand[np.argsort(-counts[cand - lo], kind="stable")]
        probes = mine[long_]
        width = 1
        while len(cand):
            ys, cand = cand[:width], cand[width:]
            wanted = (probes[:, None] + ys[None, :]).ravel()
            found = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
            overlap = counts[ys - lo] + found.reshape(len(probes), len(ys)).sum(0)
            for y in ys[linked(x, ys, overlap)].tolist():
                if comp[y] != comp[x]:
                    join(x, y)
            cand = cand[comp[cand] != comp[x]]
            width = max(1, min(4 * width, (1 << 20) // max(len(probes), 1)))
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, node)
    out = np.empty(m, np.int64)
    out[order] = least[comp]
    return out


def search_blocks(sliced: DataFrame, buckets: int, percent: int) -> DataFrame:
    """``(a, b)``: each set ``a`` of ``sliced`` (``block, i, j, side, node, n, tokens``) with the least set ``b`` that it
    reaches by links in its task, where that is another."""
    def search(rows: pa.Table) -> pa.Table:
        key = np.stack([rows.column(c).to_numpy() for c in ("block", "i", "j")], 1)
        _, task = np.unique(key, axis=0, return_inverse=True)
        task = task.ravel()
        node, n, side = (rows.column(c).to_numpy() for c in ("node", "n", "side"))
        tokens = rows.column("tokens")
        order = np.argsort(task, kind="stable")
        cuts = np.flatnonzero(np.diff(task[order], prepend=-1)).tolist()
        a, b = [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            own = order[lo:hi]
            sets = [np.frombuffer(tokens[i].as_buffer(), "<u8") for i in own.tolist()]
            least = links_in_block(node[own], n[own], sets, side[own], percent)
            moved = least != node[own]
            a.append(node[own][moved])
            b.append(least[moved])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    task = F.pmod(F.xxhash64("block", "i", "j"), F.lit(buckets))
    return sliced.withColumn("bucket", task).groupBy("bucket").applyInArrow(search, "a long, b long")


def thin_out(big: DataFrame, percent: int, rounds: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """For blocks that are too large for a task: ``(rest, edges)``, the sets that still have to be
    searched, and links found on the way.

    Each round compares all sets of a block with one of them, the pivot, and joins those that link to
    it. With Jaccard distance as metric, a joined set whose distance to the pivot is far
    enough from that of every set not joined can't link to any of those; it leaves, and so does the pivot.
    A large group of near copies is done after one round, in linear work."""
    spark, scratch = big.sparkSession, Scratch(big.sparkSession)
    far = 1 - percent / 100
    found = []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for s, p, n, pn in zip(*(part.column(c).to_pylist() for c in ("tokens", "pivot_tokens", "n", "pivot_n"))):
                both = len(np.intersect1d(np.frombuffer(s, "<u8"), np.frombuffer(p, "<u8"), assume_unique=True))
                out.append((both, 1 - both / (n + pn - both)))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("block", "node", "n", "tokens", "pivot", "pivot_n")),
                 pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())],
                ["block", "node", "n", "tokens", "pivot", "pivot_n", "both", "distance"])
    rest = scratch.cut(big.select("block", "node", "n", "tokens"))
    for _ in range(rounds):
        large = rest.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n", "tokens")).alias("p")).filter(F.col("size") > limit)
        pivots = large.select("block", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.tokens").alias("pivot_tokens"))
        measured = scratch.cut(rest.join(pivots, "block").mapInArrow(
            measure, "block long, node long, n long, tokens binary, pivot long, pivot_n long, both long, distance double"))
        if not measured.limit(1).count():
            break
        link = F.col("both") * 100 >= (F.col("n") + F.col("pivot_n") - F.col("both")) * percent
        found.append(measured.filter(link & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        nearest = measured.groupBy("block").agg(F.min(F.when(~link, F.col("distance"))).alias("nearest"))
        stays = ~link | (F.col("distance") >= F.col("nearest") - far - 1e-9)
        kept = (measured.join(nearest, "block").filter((F.col("node") != F.col("pivot")) & F.coalesce(stays, F.lit(False)))
                .select("block", "node", "n", "tokens"))
        small = rest.join(pivots.select("block"), "block", "left_anti")
        rest = scratch.cut(kept.unionByName(small))
    edges = spark.createDataFrame([], "a long, b long")
    for f in found:
        edges = edges.unionByName(f)
    return rest, edges


def link_sets(sets: DataFrame, buckets: int, percent: int = PERCENT, block_sets: int = BLOCK_SETS, rounds: int = 8) -> DataFrame:
    """``(node, label)`` of the sets (``node, n, tokens, first``) that link to others: the least node of the component."""
    scratch = Scratch(sets.sparkSession)
    blocks = components(block_edges(sets, buckets))
    placed = scratch.cut(sets.join(blocks.withColumnRenamed("label", "block"), "node").select("block", "node", "n", "tokens"))
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    large = scratch.cut(sizes.filter(F.col("size") > block_sets).select("block"))
    whole = F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")
    if not large.limit(1).count():
        edges = search_blocks(placed.select("block", *whole, "node", "n", "tokens"), buckets, percent)
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    rest, found = thin_out(placed.join(large, "block", "left_semi"), percent, rounds, block_sets)
    small = placed.join(large, "block", "left_anti").select("block", *whole, "node", "n", "tokens")
    ranked = spread_rank(rest, ["block"], F.col("node").bitwiseAND(2 ** 62 - 1), [F.col("n"), F.col("node")], "place")
    parts = ranked.groupBy("block").agg((F.floor(F.max("place") / block_sets) + 1).cast("int").alias("parts"))
    # Slice s meets every slice t in the task (min, max); its own task takes pairs within it.
    s, t = F.floor(F.col("place") / block_sets).cast("int"), F.col("t")
    pairs = (ranked.join(parts, "block").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("block", F.least(s, t).alias("i"), F.greatest(s, t).alias("j"),
                     F.when(s == t, -1).otherwise(s).alias("side"), "node", "n", "tokens"))
    edges = scratch.cut(search_blocks(small.unionByName(pairs), buckets, percent).unionByName(found))
    return components(edges)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
               block_sets: int = BLOCK_SETS, buckets: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    A document's set holds its distinct shingles of five words (runs of characters other than
    white space, A-Z lower-cased); a text of fewer words is one shingle, a null or blank
    one has none and links with nothing. Documents link when 100 * intersection >= ``percent`` *
    union. ``component_id`` is the least id that links reach.

    Equal sets are one from the start, so copies cost no pairs; no pair inside a component that is
    already joined is compared. Rows with a null id get a null ``component_id`` (unless their set
    is that of a row with an id) and carry no links. Repeated rows stay; other columns are ignored; an empty table
    gives an empty result. Shingles are told apart by 64-bit, sets by 128-bit hashes."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    passed = scratch.cut(first_pass(docs, buckets, percent))
    rows = passed.filter("kind = 1").select("doc_id", "lo", "hi", "n")
    classes = scratch.cut(rows.filter("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")))
    shared = passed.filter("kind = 0").groupBy("lo").agg(F.sum("shared").alias("shared"))
    smallest = F.floor((F.col("n") * percent + 99) / 100)
    open_ = (classes.join(shared, "lo").filter((F.col("shared") >= F.floor(smallest / 10) + 1) & F.col("least").isNotNull())
             .select(F.col("least").alias("doc_id")).distinct())
    sets = scratch.cut(second_pass(docs.join(open_, "doc_id", "left_semi"), buckets, percent))
    labels = link_sets(sets, buckets, percent, block_sets)
    labelled = scratch.cut(classes.join(labels.withColumnRenamed("node", "lo"), "lo", "left")
                           .select("lo", "hi", "least", F.coalesce("label", "lo").alias("label")))
    heads = labelled.groupBy("label").agg(F.min("least").alias("head"))
    member = scratch.cut(labelled.join(heads, "label").select("lo", "hi", "head"))
    return (rows.join(member, ["lo", "hi"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Words, distinct shingles, pairs that share one, exact overlaps, then the least id over links.
OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [w]
    ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: w[i:i + {WORDS - 1}]) END) AS s FROM words),
keyed AS (SELECT doc_id, hash(s) AS h, s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM keyed a JOIN keyed b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= {PERCENT} * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id"""
