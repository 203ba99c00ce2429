"""The prefix trie against nested dictionaries, with containers of all sizes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from estatelens.llm.prefix_trie import end_digests, op11_prefix_trie, prefix_trie, rebuilt, running, turns
from tests.conftest import SF_SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def own_turns(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(said)] for c, said in by.items()}


def again(own):
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + said[h:]
    return out


def trie(convs):
    """All nodes as (COLUMNS, members that end there), from the sequences ``convs``."""
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[b] for b in below)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], ends))
    return sorted(out, key=lambda r: (r[0], r[1]))


def built(result):
    ends = {}
    for r in result.ends.collect():
        ends.setdefault((r.conv_id, r.depth), []).append(r.member)
    rows = [tuple(r[c] for c in COLUMNS) for r in result.nodes.collect()]
    assert len({r[:2] for r in rows}) == len(rows) and set(ends) <= {r[:2] for r in rows}
    return sorted(((*r, sorted(ends.get(r[:2], []))) for r in rows), key=lambda r: (r[0], r[1]))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, a string, pos int")


def check(spark, rows, container_turns):
    own = turns(table(spark, rows))
    convs = {c: said for c, said in own_turns(rows).items()}
    ids = own.select("conv").distinct()
    assert built(prefix_trie(own, ids, container_turns)) == trie(convs)


def random_rows(seed, convs=60, texts="ab", longest=6):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", rng.choice(texts) * rng.randint(1, 2) + " w" * rng.randint(0, 1)))
    return rows


@pytest.mark.parametrize("container_turns", [1, 20, 100_000])
def test_random_conversations(spark, container_turns):
    check(spark, random_rows(container_turns, convs=30), container_turns)


@pytest.mark.parametrize("container_turns", [2, 1000])
def test_copies_long_chains_and_ends_inside(spark, container_turns):
    long = [(t, "user", f"turn {t} of many") for t in range(120)]
    rows = [(c, *t) for c in (5, 9, 30) for t in long]  # exact copies
    rows += [(c, *t) for c in (7, 8) for t in long[:50]]  # that end inside the chain
    rows += [(c, *t) for c in (2,) for t in long[:80]] + [(2, 80, "user", "another way"), (40, 0, "user", "alone"), (40, 1, "user", "")]
    rows += [(c, 0, "user", "hello") for c in range(100, 130)]  # one very common turn
    rows += [(c, 1, "bot", f"answer {c % 7}") for c in range(100, 125)]
    check(spark, rows, container_turns)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, "user", "b"), (1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", ""), (1, 0, "user", None), (2, None, "", "a"), (None, 1, "user", "lost"),
            (2, None, "user", "b"), (3, 5, None, None), (4, 5, "", ""), (6, 1, "user", "x" * 300_000 + " y"), (7, 1, "user", "x" * 300_000 + " z")]
    check(spark, rows, 2)
    check(spark, rows, 1000)


def test_role_and_text_do_not_run_together(spark):
    check(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "abc", "")], 1)


def test_no_conversations(spark):
    empty = table(spark, [(1, 0, "user", "a")]).limit(0)
    own = turns(empty)
    result = prefix_trie(own, own.select("conv"), 5)
    assert result.nodes.collect() == [] and result.ends.collect() == [] and end_digests(result.ends).collect() == []


def test_only_silent_conversations(spark):
    own = turns(table(spark, [(1, 0, "user", "a")])).limit(0)
    result = prefix_trie(own, spark.createDataFrame([(4,), (9,)], "conv long"), 5)
    assert built(result) == [(4, 0, None, 2, 0, 1, 0, [4, 9])]


@pytest.mark.parametrize("container_turns", [3, 10_000])
def test_rebuilt_families(spark, container_turns):
    """Heads of families that are missing, short or long; conversations that are left without a turn."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 20), *range(21, 35), *range(40, 60), *range(60, 63), 95]:
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user", rng.choice("pq") + f" {c % 3}"))
    want = again(own_turns(rows))
    assert any(not said for said in want.values())
    own, ids = rebuilt(turns(table(spark, rows)))
    assert built(prefix_trie(own, ids, container_turns)) == trie(want)


def test_a_long_conversation_is_ordered_by_ranges(spark):
    rng = random.Random(8)
    rows = [(1, rng.choice([None, *range(300)]), rng.choice(["user", None]), rng.choice(["same", str(rng.random())])) for _ in range(900)] + [(2, 0, "u", "t")]
    got = turns(table(spark, rows), ordered_turns=40).orderBy("conv", "pos").collect()
    want = turns(table(spark, rows)).orderBy("conv", "pos").collect()
    assert got == want and [r.pos for r in got if r.conv == 1] == list(range(900))


def test_running_sums(spark):
    rows = [("g" if n % 4 else "h", n, n % 7) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.s for r in running(df, "g", F.struct("k"), F.col("v"), "s", ["k"], rows_per_range=30).collect()}
    for g in "gh":
        total = 0
        for _, k, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[g, k] == total


def test_digests_over_many_members(spark):
    ends = [(1, 2, m) for m in range(0, 30_000, 3)] + [(1, 3, 7), (5, 0, 1_000_000_000_000), (5, 0, 9)]
    random.Random(1).shuffle(ends)
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in end_digests(spark.createDataFrame(ends, "conv_id long, depth int, member long")).collect()}
    want = {}
    for conv, depth, member in sorted(ends):
        want.setdefault((conv, depth), []).append(str(member))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("container_turns", [5, 20_000])
def test_query_against_brute_force(spark, container_turns):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = [(*r[:7], hashlib.sha256(",".join(map(str, r[7])).encode()).hexdigest()) for r in trie(again(own_turns(rows)))]
    got = op11_prefix_trie(spark, SF_SMALL, container_turns)
    assert sorted(tuple(r[c] for c in [*COLUMNS, "ends_sha256"]) for r in got.collect()) == sorted(want)
