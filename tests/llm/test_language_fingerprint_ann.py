import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from estatelens.llm import ann, fingerprint
from estatelens.llm.ann import nearest
from estatelens.llm.fingerprint import edited_text, fingerprint_edits, likeness, paragraph_keys
from estatelens.llm.language_id import fit, hashed_grams, held_out, identify, predict
from estatelens.llm.textvec import word_hashes

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(200)]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 %% !?", "en"), (1003, "the dog and the cat", None), (1004, "der hund", "en"),
           (1005, "x" * 300000, None), (1006, "漢字", None), (1007, "\U00010400", None), (None, "die katze und der hund", None), (1003, "the dog and the cat", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = [r.asDict() for r in identify(docs.repartition(3)).collect()]
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[1003]["lang_pred"] == "en" and by[1004]["lang_pred"] == "de" and by[None]["lang_pred"] == "de"
    assert by[1006]["lang_pred"] in ("en", "de") and by[1007]["lang_pred"] in ("en", "de") and not by[None]["held_out"]
    # Only the text decides: other ids, sources and languages of the same text change nothing.
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2}) == 1


def test_language_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert unlabelled.count() == 1 and identify(unlabelled).first()["lang_pred"] == "und"


def test_every_language_is_learned(spark):
    # 300 languages, each with letters of its own; the last ones have fewest rows, so the 256 with most rows leave them out.
    word = lambda i: "".join(chr(0x4E00 + 3 * i + j) for j in range(3))
    rows = [(i * 10 + n, f"{word(i)} {word(i)}", f"l{i:03d}") for i in range(300) for n in range(8 if i < 256 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = {r["lang"] for r in docs.filter(~held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert len(learned) == 300
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert len(got) == len(rows)
    assert [d for d, _, lang in rows if got[d]["lang_pred"] != lang] == []


def test_blocks_of_languages_give_one_result(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.substring("text", 1, 40).alias("text"), "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 %", None), (-3, "twin", "aa"), (-3, "twin", "zz"), (-4, "twin", None)], docs.schema)
    docs = docs.unionAll(odd)
    whole = sorted(predict(docs, fit(docs)).collect(), key=str)
    assert len(fit(docs, block_languages=2)) == 3
    for size in (1, 2, 5):
        parts = sorted(predict(docs, fit(docs, block_languages=size)).collect(), key=str)
        assert [r[:-1] for r in parts] == [r[:-1] for r in whole]
        assert [r["score"] for r in parts] == pytest.approx([r["score"] for r in whole], rel=1e-9)


def test_grams_stay_within_texts():
    whole = [hashed_grams([t], 15)[0] for t in ("abc", "d1", "", "é")]
    grams, owner, has = hashed_grams(["abc", "d1", "", "é"], 15)
    for i, w in enumerate(whole):
        assert sorted(grams[owner == i]) == sorted(w)
    assert has.tolist() == [True, True, False, True]


def test_word_hashes():
    texts = ["A b\tC", None, "", "  x  ", "a B", "c d", "\x0b\x0cA"]
    h, at, _ = word_hashes(pa.array(texts))
    words = [[w for w in (t or "").lower().replace(" ", "~").split()] for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    same = {}
    for w, x in zip(flat, h.tolist()):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)
    part, at2, _ = word_hashes(pa.array(texts).slice(3, 3))
    assert part.tolist() == h[at[3]:at[6]].tolist()


def test_sketches_peel_to_the_difference():
    r = random.Random(4)
    lines = lambda n: "\n".join("".join(r.choice("abc de") for _ in range(30)) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("a", "a"), (None, ""), (lines(5), lines(5)), ("x. " * 50, "x. " * 20)]
    pairs += [(t := lines(n), t[:len(t) // 2] + lines(n // 2)) for n in (4, 30, 300, 2000)]
    a, b = (paragraph_keys(pa.array([p[i] for p in pairs], pa.string())) for i in (0, 1))
    got = likeness(a, b, 12)
    for i in range(len(pairs)):
        x, y = (set(k[at[i]:at[i + 1]].tolist()) for k, at in (a, b))
        assert len(x) == a[1][i + 1] - a[1][i]
        assert got[i] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_fingerprints_of_edits(spark, partitions):
    r = random.Random(7)
    texts = [None, "", "a", "ab", "abc", "😀é" * 50, "line one.\nline two\n" * 30, "w " * 60000, "abc"] + [
        " ".join(r.choice("abcdef") * 3 for _ in range(r.randint(1, 200))) for _ in range(60)]
    ids = r.sample(range(-500, 500), len(texts))
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, n_chars string")
    got = {x["doc_id"]: x for x in fingerprint_edits(docs.select("doc_id", "text").repartition(5), partitions).collect()}
    line = [t or "" for _, t in sorted(rows, reverse=True)]
    assert len(got) == len(rows)
    for (d, t), x, y in zip(sorted(rows, reverse=True), line, line[1:] + line[:1]):
        e = edited_text(x, y)
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        if e == x:
            assert got[d]["near_edited"] == 1 and got[d]["fingerprint"] == got[d]["edited_fingerprint"]
    same = [got[d]["fingerprint"] for d, t in rows if t == "abc"]
    assert same[0] == same[1] and len(same) == 2


def test_edits_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint_edits(none, 3).count() == 0
    one = fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string"), 3).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    rows = [(5, "x"), (5, "x"), (5, "y"), (None, "abc"), (None, None), (4, "zzzzzz")]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 4, 5, 5, 5]
    last = next(r for r in got if r["doc_id"] is None and r["n_chars"] == 3)
    assert last["edited_sha256"] == hashlib.sha256(b"abx").hexdigest()
    assert fingerprint.edited_text("abcdef", "q") == "abcdq"


def exact(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in ok.items():
        if q % 20 == 0:
            out[q] = sorted(((-float((x * y).sum()), i) for i, y in ok.items() if i != q))[:k]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 64)
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=8) * r.uniform(0.2, 3)).tolist()) for i in range(400)]
    hot = r.normal(size=8).tolist()
    rows += [(1000 + i, hot) for i in range(100)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, vec int")
    got = {}
    for x in nearest(df.repartition(3), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = exact(rows, 20)
    assert set(got) == set(want)
    met = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        met += len({m[1] for m in mine} & {i for _, i in best})
        if q >= 1000:  # copies: ties go to the smaller ids
            assert [m[1] for m in mine] == [i for _, i in best]
    assert met >= 0.95 * 20 * len(want)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 7, 1.0), (0, 2, 20, 0.0), (20, 1, 7, 1.0), (20, 2, 0, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.filter("vec_id = 7"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_the_ascent_takes_the_longest_prefixes():
    """In each tree the range at which a query stops holds exactly the strings that share its prefix; a bit more, in all
    trees at once, would meet too few."""
    r = np.random.default_rng(2)
    sample = np.sort(r.integers(0, 1 << 63, (3, 500)), 1)
    sample[:, :200] |= 1 << 62
    sample = np.sort(sample, 1)
    keys = np.stack([r.choice(row, 40) for row in sample])
    shared = [[[ann.HASH_BITS - ((int(s) ^ int(k)) >> ann.SALT_BITS).bit_length() for s in row] for k in of] for row, of in zip(sample, keys)]
    for want in (1, 40, 400, 1500):
        stop = ann.ascent(sample, keys, want)
        for q in range(40):
            met = [sum(x >= bits for t in range(3) for x in shared[t][q]) for bits in range(ann.HASH_BITS + 2)]
            assert met[stop[q]] >= want and met[stop[q] + 1] < want
            for t in range(3):
                low, last = ann.prefix_ranges(keys[t][q:q + 1], stop[q:q + 1])
                inside = (sample[t] >= low[0]) & (sample[t] <= last[0])
                assert inside.tolist() == [x >= stop[q] for x in shared[t][q]]


def test_queries_in_blocks_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 50)
    assert sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0).collect())) == whole


def test_clustered_vectors_need_few_rows(spark):
    """Around a query of a dense place the ascent stops at a long prefix: few rows are met, and the neighbours are among them."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + r.normal(size=16) * 0.05).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    want = exact(rows, 20)
    met = sum(len(got[q] & {i for _, i in best}) for q, best in want.items())
    assert met >= 0.9 * 20 * len(want)
