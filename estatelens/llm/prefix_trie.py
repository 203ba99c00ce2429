"""Conversation prefix tries: containers of suffixes burst by next turn until they are small, then sorted and swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, table
from estatelens.llm.mixing import word_count
from estatelens.operators.ranges import cut_ranges

# Turns of a container that one task sorts and sweeps; a larger one bursts.
CONTAINER_TURNS = 20_000
# Turns of one conversation that one task puts in order, about; a longer one is cut into ranges.
ORDERED_TURNS = 2_000_000
# Fixed values: conversations come in families of 20 that share up to three first turns.
FAMILY, SHARED = 20, 4

NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          ordered_turns: int = ORDERED_TURNS) -> DataFrame:
    """``(conv long, pos int, a long, b long, words long)``: the turns of each conversation from position 0; equal (role, text) have
    equal (a, b), 128 bits of hash, others differ but for collisions.

    Turns are ordered by ``turn`` (nulls first), ties by role, then text; a null role or text is empty. Rows without a
    conversation id belong to none and are left out; repeated rows are repeated turns; other columns
    aren't read. A conversation of over about ``ordered_turns`` turns is numbered range by range."""
    said = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = running(said, "conv", F.struct("turn", "role", F.substring("text", 1, 64).alias("head")), F.lit(1), "pos",
                       ["turn", "role", "text"], ordered_turns)
    return numbered.select("conv", (F.col("pos") - 1).cast("int").alias("pos"), F.xxhash64("role", "text").alias("a"),
                           F.xxhash64(F.lit("second"), "text", "role").alias("b"), word_count(F.col("text")).alias("words"))


def running(df: DataFrame, group: str, key: Column, value: Column, name: str, order: list, rows_per_range: int = ORDERED_TURNS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row, in its group by ``order``. Large groups are summed range by range of
    ``key``, which must not decrease along ``order``, and shifted by the sums of the ranges before."""
    cut = cut_ranges(df.withColumn("_value", value.cast("long")), group, key, rows_per_range)
    inside = cut.withColumn(name, F.sum("_value").over(W.partitionBy(group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    sums = cut_ranges(df.withColumn("_value", value.cast("long")), group, key, rows_per_range, large_only=True).groupBy(group, "_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select(group, "_range", (F.sum("_sum").over(W.partitionBy(group).orderBy("_range")) - F.col("_sum")).alias("_before"))
    return (inside.join(before, [group, "_range"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .drop("_value", "_range", "_before"))


def rebuilt(own: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of the head of their family, as rows like those of ``turns``, and all their ids
    (``conv``), also of those that are left without a turn.

    Conversation c takes the first h turns of c - c % ``family`` (what there is of them), then its own after its
    first h, with h the unsigned crc32 of c's decimal digits modulo ``shared``. ``own`` is read more than once."""
    first = own.filter(F.col("pos") < shared - 1).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("first"))
    heads = first.filter(F.col("conv") % family == 0).select(F.col("conv").alias("head"), F.col("first").alias("lent"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int")
    convs = first.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("head")).join(heads, "head", "left").select(
        "conv", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("lent", F.array()), 1, F.greatest("h", F.lit(1)))).otherwise(F.array().cast(heads.schema["lent"].dataType)).alias("lent"))
    taken = convs.select("conv", F.explode("lent").alias("t")).select("conv", "t.pos", "t.a", "t.b", "t.words")
    kept = own.join(convs.select("conv", "h", F.size("lent").alias("n")), "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "a", "b", "words")
    return taken.unionByName(kept), convs.select("conv")


class Trie(NamedTuple):
    """``nodes`` as in ``NODE``, and ``ends``: ``(conv_id, depth, member)``, the node that each conversation ends at."""

    nodes: DataFrame
    ends: DataFrame


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers, in rows sorted by (head, depth, conv, pos), to rows ``(kind, NODE, member)``.

    The suffixes of a container are sorted, and a stack of open nodes follows them: what a suffix doesn't share with the
    one before is closed, the rest of it opened. A closed node is counted into its parent and comes out when
    that is closed too. Kind 0: a node; 1: what the head has below it; 2: the node that a conversation ends at."""
    out: list[list] = [[] for _ in range(9)]

    def put(*values):
        for column, v in zip(out, values):
            column.append(v)

    def flushed():
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
        names = ["kind", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "member"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        for column in out:
            column.clear()
        return batch

    def swept(head, depth, suffixes):
        # An open node: [least member, members, leaves, saved below, its own words, members that end here, closed children]
        stack = [[None, 0, 0, 0, 0, [], []]]

        def close():
            node = stack.pop()
            least, members, leaves, below, words, ended, children = node
            leaves, saved = leaves or 1, below + (members - 1) * words
            for c in children:
                put(0, c[0], depth + len(stack) + 1, least, *c[1:], None)
            for member in ended:
                put(2, least, depth + len(stack), None, None, None, None, None, member)
            up = stack[-1]
            up[0] = least if up[0] is None else min(up[0], least)
            up[1] += members
            up[2] += leaves
            up[3] += saved
            up[6].append((least, members, len(children), leaves, saved))

        last = b""
        for ids, conv, words in sorted((b"".join(ids), conv, words) for ids, conv, words in suffixes):
            same = next((i for i in range(min(len(ids), len(last)) // 16) if ids[16 * i:16 * i + 16] != last[16 * i:16 * i + 16]), min(len(ids), len(last)) // 16)
            while len(stack) > same + 1:
                close()
            stack += [[None, 0, 0, 0, w, [], []] for w in words[same:]]
            top = stack[-1]
            top[0] = conv if top[0] is None else min(top[0], conv)
            top[1] += 1
            top[5].append(conv)
            last = ids
        while len(stack) > 1:
            close()
        for c in stack[0][6]:
            put(0, c[0], depth + 1, head, *c[1:], None)
        put(1, head, depth, None, None, len(stack[0][6]), stack[0][2], stack[0][3], None)

    key, suffixes = None, []
    for batch in batches:
        ids = np.column_stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]).astype(">i8")
        for i, (head, depth, conv, words) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("head", "depth", "conv", "words")])):
            if (head, depth) != key:
                if key:
                    swept(*key, suffixes)
                key, suffixes = (head, depth), []
            if not suffixes or suffixes[-1][1] != conv:
                suffixes.append(([], conv, []))
            suffixes[-1][0].append(ids[i].tobytes())
            suffixes[-1][2].append(words)
            if len(out[0]) > 50_000:
                yield flushed()
    if key:
        swept(*key, suffixes)
    yield flushed()


HEAD = ["head", "depth"]


def burst(big: DataFrame, container_turns: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over containers with too many turns, ``big`` (head, depth, conv, pos, a, b, words, len).

    The turns that all suffixes of a container share at its start make a chain of nodes at once; at the fork behind it
    each next turn id heads a container of its own. Returns ``(forks, chain, children, routed, ends)``: a row per
    container with the place of its fork; the turns of its chain; its new containers; the turns behind the
    fork under their new heads, with the kind of container; and the conversations that end on the way.

    What is grouped is summed before it is shuffled, so a turn that a third of all conversations share makes one
    row a task."""
    by_pos = big.groupBy(*HEAD, "pos").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), (F.min("a") != F.max("a")).alias("d1"), (F.min("b") != F.max("b")).alias("d2"))
    starts = by_pos.filter("pos = depth").select(*HEAD, F.col("n").alias("all"), F.col("least").alias("through"))
    parted = F.col("d1") | F.col("d2") | (F.col("n") < F.col("all"))
    forks = scratch.cut(by_pos.join(starts, HEAD).groupBy(*HEAD, "all", "through").agg(
        F.coalesce(F.min(F.when(parted, F.col("pos"))), F.max("pos") + 1).alias("fork")))
    tagged = big.join(forks, HEAD)
    chain = scratch.cut(tagged.filter("conv = through and pos < fork").select(*HEAD, "pos", "words"))
    at_fork = tagged.filter("pos = fork")
    kind = F.expr(f"case when behind = 0 then 'leaf' when n = 1 then 'single' when behind <= {container_turns} then 'small' else 'big' end")
    children = scratch.cut(
        at_fork.groupBy(*HEAD, "fork", "through", "a", "b").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"),
                                                               F.sum(F.col("len") - F.col("pos") - 1).alias("behind")).withColumn("kind", kind))
    routes = scratch.cut(at_fork.join(children.select(*HEAD, "a", "b", "child", "kind"), [*HEAD, "a", "b"])
                         .select("conv", "child", (F.col("fork") + 1).alias("child_depth"), "kind", "len"))
    routed = scratch.cut(tagged.filter("pos > fork").drop("head", "depth").join(routes.drop("len"), "conv")
                         .select(F.col("child").alias("head"), F.col("child_depth").alias("depth"), "conv", "pos", "a", "b", "words", "len", "kind"))
    ends = scratch.cut(routes.filter("len = child_depth").select(F.col("child").alias("conv_id"), F.col("child_depth").alias("depth"), F.col("conv").alias("member"))
                       .unionByName(tagged.filter("pos = fork - 1 and len = fork").select(F.col("through").alias("conv_id"), F.col("fork").alias("depth"), F.col("conv").alias("member"))))
    return forks, chain, children, routed, ends


def prefix_trie(turns: DataFrame, convs: DataFrame, container_turns: int = CONTAINER_TURNS) -> Trie:
    """The trie of all conversations: ``turns`` (conv, pos, a, b, words; positions gapless from 0) and ``convs`` (conv, distinct: all ids, also
    of conversations without turns).

    A node is a distinct sequence of first turns; its id is the smallest conversation that starts with it, which with the
    depth tells it from all others. Containers of suffixes lie under heads, the root at first. Those over
    ``container_turns`` turns burst, round by round, until none is left; each round passes at least one fork
    on every path. Containers of one suffix need no sorting: their turns are nodes as they
    are, however many. The others are dealt out by head, sorted and swept, one container at a time in memory.
    Sums of subtrees then go back up, round by round. Everything between rounds is written to the shared scratch folder.

    Without conversations there is no node. The number of rounds follows the forks on one path, not its length."""
    spark = turns.sparkSession
    scratch = Scratch(spark)
    root, total = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    long, none = (lambda c: F.lit(c).cast("long")), F.lit(None).cast("long")
    if not total:
        return Trie(spark.createDataFrame([], NODE), spark.createDataFrame([], "conv_id long, depth int, member long"))
    lengths = turns.groupBy("conv").agg((F.max("pos") + 1).alias("len"))
    rows = scratch.cut(turns.join(lengths, "conv").select(long(root).alias("head"), F.lit(0).alias("depth"), "conv", "pos", "a", "b", "words", "len"))
    silent = convs.join(lengths, "conv", "left_anti")
    ends = [silent.select(long(root).alias("conv_id"), F.lit(0).alias("depth"), F.col("conv").alias("member"))]
    small, single, levels = [], [], []
    if rows.count() <= container_turns:
        small.append(rows)
    else:
        big = rows
        while True:
            *level, routed, ended = burst(big, container_turns, scratch)
            levels.append(level)
            ends.append(ended)
            small.append(routed.filter("kind = 'small'").drop("kind"))
            single.append(routed.filter("kind = 'single'").drop("kind"))
            if level[-1].filter("kind = 'big'").isEmpty():
                break
            big = routed.filter("kind = 'big'").drop("kind")

    def all_of(frames: list[DataFrame]) -> DataFrame:
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        return whole

    swept = scratch.cut(all_of(small).select(*HEAD, "conv", "pos", "a", "b", "words").repartition(*HEAD).sortWithinPartitions(*HEAD, "conv", "pos")
                        .mapInArrow(sweep, f"kind int, {NODE}, member long"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    nodes = [swept.filter("kind = 0").select(*columns)]
    ends.append(swept.filter("kind = 2").select("conv_id", "depth", "member"))
    for alone in single:
        last = F.col("pos") + 1 == F.col("len")
        nodes.append(alone.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"), long(1).alias("n_convs"),
                                  F.when(last, long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens")))
        ends.append(alone.filter(last).select(F.col("conv").alias("conv_id"), F.col("len").alias("depth"), F.col("conv").alias("member")))

    # What lies below the head of a container: its children, its leaves (itself without children), what its subtrees save.
    below = swept.filter("kind = 1").select(F.col("conv_id").alias("head"), "depth", "n_children", "n_leaves", "saved_tokens")
    tops = below
    for forks, chain, children in reversed(levels):
        found = tops.select(F.col("head").alias("child"), (F.col("depth") - 1).alias("fork"), "n_children", "n_leaves", F.col("saved_tokens").alias("beneath"))
        kids = scratch.cut(children.join(found, ["child", "fork"], "left").select(
            *HEAD, F.col("child").alias("conv_id"), (F.col("fork") + 1).alias("child_depth"), F.when(F.col("fork") == F.col("depth"), F.col("head")).otherwise(F.col("through")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.coalesce("n_children", F.when(F.col("behind") == 0, 0).otherwise(1).cast("long")).alias("n_children"),
            F.coalesce("n_leaves", long(1)).alias("n_leaves"), (F.coalesce("beneath", long(0)) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens")))
        nodes.append(kids.select("conv_id", F.col("child_depth").alias("depth"), *columns[2:]))
        sums = kids.groupBy(*HEAD).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        forked = scratch.cut(forks.join(sums, HEAD, "left").select(*HEAD, "all", "through", "fork", F.coalesce("n_children", long(0)).alias("n_children"),
                                                                   F.coalesce("n_leaves", long(1)).alias("n_leaves"), F.coalesce("saved", long(0)).alias("saved")))
        summed = running(chain.withColumn("container", F.struct(*HEAD)), "container", F.struct((-F.col("pos")).alias("back")), F.col("words"), "words_on", [F.desc("pos")])
        nodes.append(summed.join(forked, HEAD).select(
            F.col("through").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("head")).otherwise(F.col("through")).alias("parent_conv_id"),
            F.col("all").alias("n_convs"), F.when(F.col("pos") + 1 == F.col("fork"), F.col("n_children")).otherwise(long(1)).alias("n_children"), "n_leaves",
            ((F.col("all") - 1) * F.col("words_on") + F.col("saved")).alias("saved_tokens")))
        links = chain.groupBy(*HEAD).agg(F.sum("words").alias("on"))
        heads = forked.join(links, HEAD, "left").select(*HEAD, F.when(F.col("fork") > F.col("depth"), long(1)).otherwise(F.col("n_children")).alias("n_children"), "n_leaves",
                                                        (F.coalesce((F.col("all") - 1) * F.col("on"), long(0)) + F.col("saved")).alias("saved_tokens"))
        # The round before needs the heads of this one, beside those that were swept.
        tops = below.unionByName(scratch.cut(heads))
    top = tops.filter((F.col("head") == root) & (F.col("depth") == 0))
    alone = spark.range(1).select(long(root).alias("head"), F.lit(0).alias("depth")).join(top, HEAD, "left")
    nodes.append(alone.select(F.col("head").alias("conv_id"), "depth", none.alias("parent_conv_id"), long(total).alias("n_convs"), F.coalesce("n_children", long(0)).alias("n_children"),
                              F.coalesce("n_leaves", long(1)).alias("n_leaves"), F.coalesce("saved_tokens", long(0)).alias("saved_tokens")))
    return Trie(all_of([n.select(*columns) for n in nodes]), all_of(ends))


def end_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, ends_sha256)``: of the members that end at a node, their decimal ids, ascending and comma-joined.

    A digest reads its list in order, so a node's members are streamed through one task, sorted by Spark and never
    held; nodes are dealt over all tasks."""
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            node, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
            new = np.r_[True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])] if len(node) else np.zeros(0, bool)
            cuts = [*np.flatnonzero(new).tolist(), len(node)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                ids = ",".join(map(str, member[a:b].tolist())).encode()
                if key == (node[a], depth[a]):
                    state.update(b"," + ids)
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (node[a], depth[a]), hashlib.sha256(ids)
            yield as_batch(done)
        if key:
            yield as_batch([(*key, state.hexdigest())])

    def as_batch(done):
        columns = list(zip(*done)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    return (ends.select("conv_id", "depth", "member").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
            .mapInArrow(digested, "conv_id long, depth int, ends_sha256 string"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    own = Scratch(spark).cut(turns(table(spark, sf_dir, "conversations")))
    again, convs = rebuilt(own)
    trie = prefix_trie(again, convs, container_turns)
    named = trie.nodes.join(end_digests(trie.ends), ["conv_id", "depth"], "left")
    return named.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


OP11_SQL = r"""
WITH bits AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS b)),
steps AS (SELECT list(v ORDER BY b) AS step FROM bits),
own AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv::varchar, ''), lambda d: ord(d)::bigint)),
      lambda c, o: xor(c >> 8, step[(xor(c, o) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv FROM own), steps),
rebuilt AS (
  SELECT c.conv, 0 AS part, o.pos AS place, o.role, o.text FROM convs c JOIN own o ON o.conv = c.conv - c.conv % 20 AND o.pos < c.h
  UNION ALL SELECT c.conv, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv = c.conv AND o.pos >= c.h),
said AS (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY part, place) AS depth,
    len(regexp_extract_all(text, '[^ 	-]+')) AS words,
    string_agg(sha256(length(role)::varchar || ':' || role || text), ',') OVER (PARTITION BY conv ORDER BY part, place) AS prefix
  FROM rebuilt),
paths AS (
  SELECT conv, depth, words, prefix FROM said UNION ALL SELECT conv, 0, 0, '' FROM convs),
nodes AS (
  SELECT depth, prefix, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM paths GROUP BY depth, prefix),
placed AS (
  SELECT p.conv, n.depth, n.prefix, n.conv_id FROM paths p JOIN nodes n ON p.depth = n.depth AND p.prefix = n.prefix),
children AS (
  SELECT up.depth, up.prefix, count(*) AS n_children
  FROM nodes n JOIN placed up ON up.conv = n.conv_id AND up.depth = n.depth - 1 GROUP BY up.depth, up.prefix),
parents AS (
  SELECT n.depth, n.prefix, up.conv_id AS parent_conv_id FROM nodes n JOIN placed up ON up.conv = n.conv_id AND up.depth = n.depth - 1),
tree AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.prefix = c.prefix),
sums AS (
  SELECT up.depth, up.prefix, sum(t.saved) AS saved_tokens, count(*) FILTER (WHERE t.n_children = 0) AS n_leaves
  FROM tree t JOIN placed up ON up.conv = t.conv_id AND up.depth <= t.depth GROUP BY up.depth, up.prefix),
tails AS (SELECT conv, max(depth) AS depth FROM paths GROUP BY conv),
ends AS (
  SELECT p.depth, p.prefix, string_agg(p.conv::varchar, ',' ORDER BY p.conv) AS ids
  FROM placed p JOIN tails t ON p.conv = t.conv AND p.depth = t.depth GROUP BY p.depth, p.prefix)
SELECT t.conv_id, t.depth::bigint AS depth, p.parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::bigint AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t JOIN sums s ON t.depth = s.depth AND t.prefix = s.prefix
LEFT JOIN parents p ON t.depth = p.depth AND t.prefix = p.prefix
LEFT JOIN ends e ON t.depth = e.depth AND t.prefix = e.prefix
"""
