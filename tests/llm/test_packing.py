import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from estatelens.llm import packing
from estatelens.llm.packing import best_fit, encoder, pack, settle


def sequential_best_fit(needs, capacity):
    gaps, n = [], 0
    for need in sorted(needs, reverse=True):
        i = bisect.bisect_left(gaps, need)
        if i == len(gaps):
            n += 1
            bisect.insort(gaps, capacity - need)
        else:
            bisect.insort(gaps, gaps.pop(i) - need)
    return n


def checked(rows, needs, capacity):
    """The number of sequences, after checking that they are whole, gapless and not too long."""
    seqs = defaultdict(list)
    for item, seq, offset in rows:
        seqs[seq].append((offset, needs[item]))
    assert sum(map(len, seqs.values())) == len(needs)
    for parts in seqs.values():
        at = 0
        for offset, need in sorted(parts):
            assert offset == at
            at += need
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("case", ["mixed", "tiny", "hot"])
def test_best_fit(spark, case):
    r = random.Random(case)
    needs = {"mixed": [r.choice([r.randint(1, 100), r.randint(1, 30), 100]) for _ in range(300)] + [50] * 31 + [51] * 10,
             "tiny": [1] * 300 + [2] * 50, "hot": [34] * 150 + [r.randint(40, 100) for _ in range(60)]}[case]
    items = spark.createDataFrame(list(enumerate(needs)), "item long, need int").repartition(3)
    got = [tuple(x) for x in best_fit(items, 100).collect()]
    n = checked(got, needs, 100)
    assert n <= sequential_best_fit(needs, 100) * 1.03 + 1


def test_no_items(spark):
    assert best_fit(spark.createDataFrame([], "item long, need int"), 100).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_sweep_and_settle_give_each_item_its_smallest_gap(monkeypatch, seed):
    """Ranges swept apart and settled give what one sweep over all sizes gives."""
    r = random.Random(seed)
    items = [(i, r.randint(1, 50)) for i in range(60)]
    gaps = [(1000 + i, r.randint(1, 50)) for i in range(50)]
    rows = sorted([(-s, False, 0, i, s) for i, s in gaps] + [(-s, True, i, 0, s) for i, s in items])
    stack, want = [], {}
    for _, is_item, i, seq, size in rows:
        if not is_item:
            stack.append((seq, size))
        elif stack:
            want[i] = stack.pop()[1]
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    pairs, left_items, left_gaps, left = {}, {}, {}, []

    class Task:
        part = 0

        def partitionId(self):
            return self.part
    task = Task()
    monkeypatch.setattr(packing.TaskContext, "get", lambda: task)
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        task.part = part
        cols = list(zip(*rows[a:b]))
        batch = pa.RecordBatch.from_arrays([pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.int32()), pa.array(cols[1])],
                                           ["item", "seq", "size", "is_item"])
        i = g = 0
        for out in packing.sweep(iter([batch])):
            for x in out.to_pylist():
                if x["place"] is None and x["item"] is not None:
                    pairs[x["item"]] = x["gap"]
                elif x["item"] is not None:
                    left_items[part, x["place"]] = x["item"]
                    i += 1
                elif x["seq"] is not None:
                    left_gaps[part, x["place"]] = x["gap"]
                    g += 1
                else:
                    assert (x["need"], x["gap"], x["part"]) == (i, g, part)
        left.append((part, i, g))
    for part, first, end, gap_part, last in settle(left):
        for k in range(first, end):
            pairs[left_items[part, k]] = left_gaps[gap_part, last - (k - first)]
    assert pairs == want


@pytest.fixture(scope="module")
def own():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, " ", "a", "Hello, world!\n\n  It's 12345 o'clock\t...", "é ü ß 漢字 😀👩‍👩‍👧 ​ x", "<|endoftext|> <|endoftext|>",
         "x" * 5000, " " * 3000, "\n" * 500, "word " * 9000, "".join(chr(c) for c in range(32, 1500)), "don't DON'T we'll", "퟿\x00\x01"]


def test_ids_are_those_of_the_tokenizer_file(own):
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in TEXTS:
        assert encode(t or "").tolist() == own.encode(t or "", add_special_tokens=False).ids
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder(public_tokenizers.path("word_bpe_49k.json"))("Hello there").tolist() == other.encode("Hello there", add_special_tokens=False).ids


def test_pack(spark, own):
    rows = [(i, t, "mine", 1) for i, t in enumerate(TEXTS)] + [(3, "a", "mine", 1), (None, "no id", "mine", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Sequence_Id string, _item int")
    got = [r.asDict() for r in pack(docs.repartition(2)).collect()]
    pieces = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["_item"] == 1
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        if i == 3:
            assert [p[2] for p in pieces[3]] == [ids, ids]
            continue
        mine = sorted(pieces[i])
        assert [x for p in mine for x in p[2]] == ids
        assert [p[0] for p in mine] == list(range(len(mine)))
        assert [p[1] for p in mine] == np.cumsum([0] + [len(p[2]) for p in mine[:-1]]).tolist()
        assert all(len(p[2]) == 2048 for p in mine[1:])
    needs = dict(enumerate(r["length"] for r in got))
    assert checked([(k, r["sequence_id"], r["offset"]) for k, r in enumerate(got)], needs, 2048) <= sequential_best_fit(needs.values(), 2048) + 1
    assert pack(docs.limit(0)).count() == 0
    assert "ids" not in pack(docs.limit(0), with_ids=False).columns
