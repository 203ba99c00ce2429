import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from estatelens.llm.common import Scratch, spread_rank
from tests.llm.test_ngram_join import linked, shingles

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = Scratch(spark).cut(stage(spark, docs, SMALL))
        out.append((name, docs, after))
        docs = after
    return out


def test_each_stage_returns_documents(stages):
    assert [s[0] for s in stages] == ["language_id", "ngram_join", "secret_scan", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_language_stage_keeps_all_with_letters(stages):
    _, before, after = stages[0]
    assert rows_of(after) == rows_of(before.filter(F.col("text").rlike(r"\p{L}")))


def test_unsure_languages_stay(spark):
    # Four labels share the same words, so each has a posterior of about a quarter; "und" is a label like others.
    rows = [(i, "the cat and the dog", ("en", "en-GB", "en-US", "und")[i % 4]) for i in range(200)] + [(1000, "der Hund", None), (1001, "12 %", "en"), (1002, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert rows_of(P.language_id(spark, docs, SMALL)) == rows_of(docs.filter("doc_id <= 1000"))


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    rows = before.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups[root(i)] = min(r["doc_id"], groups.get(root(i), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(groups.values())


def test_secrets_are_gone_and_else_nothing(stages):
    _, before, after = stages[2]
    old, new = ({r["doc_id"]: r for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    for d in old:
        if old[d]["text"] != new[d]["text"]:
            assert re.search(r"\[(assign|access|hex|github|slack|jwt|pem)\]", new[d]["text"])
        assert new[d]["n_chars"] == len(new[d]["text"])
        assert not re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", new[d]["text"])


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    old = {r["doc_id"]: r for r in before.collect()}
    times = Counter(r["doc_id"] for r in after.collect())
    assert set(times) <= set(old) and max(times.values()) <= 2
    assert all(tuple(r) == tuple(old[r["doc_id"]]) for r in after.collect())
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert sum(size(old[d]) * n for d, n in times.items()) == pytest.approx(1.5 * sum(map(size, old.values())), rel=0.15)


def test_packing_holds_every_row(stages):
    _, before, after = stages[4]
    assert after.filter("piece = 0").count() == before.count()
    seqs = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert seqs.filter("n > 2048 or n <> end").count() == 0


def odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5, 0.1), (1, text + " x", "en", "a", 5, 0.1), (1, "other words of that id", "en", "a", 5, 0.1), (None, text, None, None, None, None),
            (None, None, None, None, None, None), (2, "", "en", "b", 0, 0.2), (3, "12 34", "en", "b", 5, 0.2), (4, "token=abcdefgh here", None, None, 1, 0.3),
            (4, "token=abcdefgh here", None, None, 1, 0.3), (5, "long text " * 20000, "de", "b", 1, 0.4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size double")


def test_odd_rows_pass_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in P.STAGES[:-1]:
        after = Scratch(spark).cut(stage(spark, docs, SMALL))
        assert after.dtypes == docs.dtypes, name
        if name == "ngram_join":
            assert Counter(r["text"] for r in after.filter("text like 'w0 %'").collect()).total() == 1
            assert after.filter("text = 'other words of that id'").count() == 1
            assert after.filter("doc_id = 4").count() == 1
        if name == "secret_scan":
            assert [r["text"] for r in after.filter("doc_id = 4").collect()] == ["[assign] here"]
        docs = after
    assert P.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count() > 0


def test_empty_documents_pass_every_stage(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in P.STAGES:
        assert Scratch(spark).cut(stage(spark, docs, SMALL)).count() == 0, name


def test_run(spark, stages):
    got = P.run(spark, SMALL)
    assert got.count() == stages[-1][2].count()


def test_spread_rank(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"g{i}", i, i % 7) for i in range(200)], "g string, i long, _part int")
    got = spread_rank(rows, ["g"], F.col("i"), [F.col("i")], "place", rows_per_task=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["place"])
        assert r["_part"] == r["i"] % 7
    assert all(sorted(p) == list(range(len(p))) for p in by.values()) and len(got) == 200
