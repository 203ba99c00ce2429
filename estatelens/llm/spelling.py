"""Spelling variants: words one edit apart, found in the neighbourhoods of their forms in a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, table
from estatelens.llm.textvec import slices

# Letters of words after lower-casing A-Z.
LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, SLIP = 6, 5, 5, 199
# Letters are hashed to so many symbols: more of them make larger neighbourhoods with fewer false candidates.
SYMBOLS = 8
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
# Words up to this length meet by neighbourhoods, whose size is the length times twice the symbols; two longer
# words meet by halves.
LONG = 40
# Runs of one long text, and words of a task, that are counted before they are passed on.
AT_ONCE = 1 << 17


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, slip: int | None = None) -> DataFrame:
    """``(word string, n long)``: the maximal runs of letters of all texts, A-Z lower-cased, of at least ``min_length``
    code points and ``min_count`` occurrences.

    ``slip`` plants typing errors: where it divides ``h``, the unsigned crc32 of ``<doc_id>:<run>``, the
    run loses its code point at ``h`` modulo its length (an error of a document is thus always the same).
    A null id is empty there. Null and empty texts have no words; a very long text is counted a block at a time; repeated
    rows count again; other columns are not read. Each task sends a word on once for some hundred
    thousand words, so a frequent word makes few rows."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for part in slices(batches, "text"):
            for doc, raw in zip(part.column(0).to_pylist(), pc.cast(part.column(1), pa.large_binary()).to_pylist()):
                found = runs.finditer((raw or b"").lower().decode())  # of bytes, this lower-cases A-Z only
                seed = zlib.crc32(f"{doc}:".encode())
                while block := Counter(m.group() for m in islice(found, AT_ONCE)):
                    for run, n in block.items():
                        if slip:
                            h = zlib.crc32(run.encode(), seed)
                            if h % slip == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1:]
                                if len(run) < min_length:
                                    continue
                        total[run] += n
                    if len(total) >= AT_ONCE:
                        yield passed_on()
        yield passed_on()

    partial = rows.mapInArrow(counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """``word`` with every code point hashed to one of the first ``symbols`` (at most 36) of ``DIGITS``."""
    if not 1 <= symbols <= len(DIGITS):
        raise ValueError(f"symbols must be from 1 to {len(DIGITS)}")
    digit = lambda c: F.substr(F.lit(DIGITS), (F.xxhash64(c).bitwiseAND(F.lit(1023)) % symbols + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.split(word, ""), digit), "")


def neighbourhood(form: Column, symbols: int = SYMBOLS) -> Column:
    """All strings over the digits that ``form`` becomes by at most one deletion, replacement or insertion, each once."""
    digits = F.array(*[F.lit(d) for d in DIGITS[:symbols]])
    head, tail = (lambda i: F.substr(form, F.lit(1), i)), (lambda i: F.substr(form, i))
    places = F.sequence(F.lit(1), F.length(form))
    deleted = F.transform(places, lambda i: F.concat(head(i - 1), tail(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(digits, lambda d: F.concat(head(i - 1), d, tail(i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), F.length(form)), lambda i: F.transform(digits, lambda d: F.concat(head(i), d, tail(i + 1)))))
    return F.array_distinct(F.concat(deleted, replaced, inserted))


def one_edit_pairs(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """``(word, near)`` for all words of ``words`` (distinct ``word``) that differ by exactly one inserted, deleted or
    replaced code point, in both directions.

    Each distinct reduced form sends out its neighbourhood as 64-bit hashes; where one meets the hash of
    another form, the words of both are compared as they are. Hashes that collide cost a comparison, never a
    pair. Pairs of words over ``long`` agree on their first or on their last half (of the shorter one), and
    meet by the hash of that half: linear in the length of a word."""
    one_edit = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    shorter = F.least(F.length("word"), F.length("near"))
    forms = words.filter(F.length("word") <= long + 1).select("word", reduced(F.col("word"), symbols).alias("form"))
    keyed = forms.select("word", F.xxhash64("form").alias("at"))
    # The forms are few bytes and much work: as many tasks as a shuffle has partitions, not as few as their bytes fill.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = forms.select("form").distinct().repartition(tasks, "form").select(
        F.xxhash64("form").alias("from"), F.explode(F.transform(neighbourhood(F.col("form"), symbols), lambda s: F.xxhash64(s))).alias("at"))
    meeting = spread.join(keyed.select("at").distinct(), "at")
    short = (meeting.join(keyed.select("word", F.col("at").alias("from")), "from").select("word", "at")
             .join(keyed.select(F.col("word").alias("near"), "at"), "at")
             .filter((shorter <= long) & one_edit).select("word", "near"))

    # Of two long words the shorter has m points: a word is tried as that one, and as the one with a point more.
    size = F.length("word")
    halves = F.transform(F.array(size, size - 1), lambda m: F.struct(
        m.alias("m"), F.xxhash64(F.substr("word", F.lit(1), F.floor(m / 2).cast("int"))).alias("first"),
        F.xxhash64(F.substr("word", (size - F.floor(m / 2) + 1).cast("int"))).alias("last")))
    sided = words.filter(size > long).select("word", F.explode(halves).alias("h"))
    keys = sided.select("word", F.explode(F.array(F.struct("h.m", F.lit(0).alias("side"), F.col("h.first").alias("half")),
                                                  F.struct("h.m", F.lit(1).alias("side"), F.col("h.last").alias("half")))).alias("key"))
    far = (keys.join(keys.withColumnRenamed("word", "near"), "key").filter((shorter > long) & one_edit)
           .select("word", "near").distinct())
    return short.unionByName(far)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every row ``(word, form)`` of ``forms``: the last word that is reached by going from word to
    form. ``forms`` must lead to no circle. The distance covered doubles each round."""
    scratch = Scratch(forms.sparkSession)
    reached = scratch.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.cut(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(reached)
        reached = after.drop("moved")
        if after.filter("moved").isEmpty():
            return reached


def spelling_variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row ``(word string, n long)`` of ``words``.

    ``n_near`` counts the words one edit away. ``form`` is the one of these with the largest ``n``, the
    smallest in code-point order of equals, if that is at least ``ratio`` (over 1) times the word's own; ``root`` is where
    forms lead, the word itself without one. Words must be distinct and not null; an empty table
    gives an empty result; other columns are left out."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms may run in circles")
    scratch = Scratch(words.sparkSession)
    words = scratch.cut(words.select("word", "n"))
    pairs = one_edit_pairs(words, symbols, long).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = scratch.cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=SLIP))


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS b)),
steps AS (SELECT list(v ORDER BY b) AS step FROM bits),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) AS x FROM counted),
digests AS (
  SELECT run, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
      lambda c, o: xor(c >> 8, step[(xor(c, o) & 255) + 1])), 4294967295) AS h
  FROM hexed, steps),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM digests),
words AS (SELECT word, sum(n)::bigint AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS rn
  FROM pairs),
judged AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON w.word = r.word),
walk AS (
  SELECT word, word AS here, form AS next FROM judged
  UNION ALL SELECT k.word, j.word, j.form FROM walk k JOIN judged j ON k.next = j.word)
SELECT j.word, j.form, k.here AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN walk k ON j.word = k.word AND k.next IS NULL
"""
