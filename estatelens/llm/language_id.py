"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from estatelens.llm.common import Scratch, fresh, table
from estatelens.llm.textvec import keys64, slices

UNKNOWN = "und"
N_GRAMS = (1, 2, 3)
HASH_BITS = 15
# The model holds one row of log probabilities per language, in broadcast blocks of so many languages.
BLOCK_LANGUAGES = 256
SMOOTHING = 0.5

_CHAR_KEYS = keys64(max(N_GRAMS) + 2, 5)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


_IS_LETTER: list[np.ndarray] = []


def hashed_grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(grams, text, has_letter)``: hashed n-grams of the lower-cased texts, the text of each
    gram, and whether a text has a letter. Other characters count as one blank sign each;
    n-grams of blanks only are left out."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    low = [t.lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = chars > 0xFFFF
    letter = _IS_LETTER[0][np.where(wide, 0, chars)]
    if wide.any():
        known, back = np.unique(chars[wide], return_inverse=True)
        letter[wide] = np.fromiter((chr(c).isalpha() for c in known), bool, len(known))[back]
    doc = np.repeat(np.arange(len(low), dtype=np.int32), lens)
    has = np.zeros(len(low), bool)
    has[doc[letter]] = True
    chars = np.where(letter, chars, 32).astype(np.uint64)
    keyed = [chars * key for key in _CHAR_KEYS[:max(N_GRAMS) + 1, None]]
    grams, owners = [], []
    for n in N_GRAMS:
        k = len(chars) - n + 1
        if k <= 0:
            break
        # Multiply-shift: the top bits of a sum of odd multiples. The multiples are shared by all lengths.
        h = keyed[n][:k] + _CHAR_KEYS[-1:] * np.uint64(n)
        some = letter[:k].copy()
        for i in range(1, n):
            h += keyed[i][i:i + k]
            some |= letter[i:i + k]
        ok = some & (doc[:k] == doc[n - 1:])
        grams.append((h[ok] >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(doc[:k][ok])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(grams), np.concatenate(owners), has


def gram_counts(labelled: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """``(lang, gram, n)`` over all rows ``(lang, text)``; each task adds up its rows before the shuffle,
    in sums of at most ``BLOCK_LANGUAGES`` languages at once."""
    def flat(langs: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))],
                                          ["lang", "gram", "n"])

    def emptied(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while sums:
            lang, row = sums.popitem()
            at = np.flatnonzero(row)
            yield flat(np.full(len(at), lang, object), at, row[at])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            grams, owner, _ = hashed_grams([t or "" for t in part.column("text").to_pylist()], bits)
            langs, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            keys = (code[owner].astype(np.int64) << bits) + grams
            if len(langs) > BLOCK_LANGUAGES:
                keys, n = np.unique(keys, return_counts=True)
                yield flat(langs[keys >> bits], keys & ((1 << bits) - 1), n)
                continue
            if sums and len(sums.keys() | set(langs)) > BLOCK_LANGUAGES:
                yield from emptied(sums)
            found = np.bincount(keys, minlength=len(langs) << bits)
            for lang, row in zip(langs, found.reshape(len(langs), -1)):
                sums[lang] = sums[lang] + row if lang in sums else row
        yield from emptied(sums)
    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, gram int, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, bits: int = HASH_BITS, block_languages: int = BLOCK_LANGUAGES) -> list[Broadcast]:
    """The model of all rows ``(lang, text)`` with a language and a text: every language, in order of name, in
    broadcast blocks ``(languages, log_prior, log_prob)`` of ``block_languages``. No language: no block.

    What the driver holds is the names and one block, at most ``block_languages`` rows of 2 ** ``bits`` counts."""
    spark = labelled.sparkSession
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    prior = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(prior)
    names = [languages[i:i + block_languages] for i in range(0, len(languages), block_languages)]
    scratch, counted = Scratch(spark), gram_counts(labelled, bits)
    if len(names) > 1:  # read once for each block
        counted = scratch.cut(counted)
    rows, blocks = sum(prior.values()), []
    for block in names:
        counts = np.full((len(block), 1 << bits), SMOOTHING)
        got = (counted.filter(F.col("lang").isin(*block)) if len(names) > 1 else counted).toPandas()
        counts[np.searchsorted(block, got["lang"].to_numpy(object)), got["gram"].to_numpy()] += got["n"].to_numpy()
        share = np.array([prior[x] for x in block], float)
        blocks.append(spark.sparkContext.broadcast((block, np.log(share / rows), np.log(counts / counts.sum(1, keepdims=True)))))
    scratch.drop(counted)
    return blocks


def likeliest(texts: list[str], block: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(best, peak, spread, known)`` of each text: the likeliest language of ``block``, its log likelihood, the
    likelihood of all of the block as a multiple of that, and whether the text has a letter."""
    _, prior, log_prob = block
    grams, owner, known = hashed_grams(texts, int(log_prob.shape[1]).bit_length() - 1)
    n = len(texts)
    # One sum per language over the grams that the texts hold: first over each run of one text's grams.
    runs = np.flatnonzero(np.diff(owner, prepend=-1))
    like = np.stack([np.bincount(owner[runs], np.add.reduceat(row.take(grams), runs), n) if len(runs) else np.zeros(n)
                     for row in log_prob], 1) + prior
    peak = like.max(1)
    return like.argmax(1), peak, np.exp(like - peak[:, None]).sum(1), known


def predict(docs: DataFrame, model: list[Broadcast], text: str = "text",
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with a language and its posterior probability (``und``: 0) under the names ``out``.

    One block of languages is scored in one pass. More are scored by tasks of one block each, and
    each row's likeliest languages and sums of the blocks are merged to those of all languages."""
    rows = docs.select(*[c for c in docs.columns if c.lower() not in (out[0].lower(), out[1].lower())])
    if not model:
        return rows.select("*", F.lit(UNKNOWN).alias(out[0]), F.lit(0.0).alias(out[1]))
    if len(model) > 1:
        return _predict_blocks(rows, model, text, out)
    sent, = model
    rows_names = rows.columns
    place = [c.lower() for c in rows_names].index(text.lower())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*sent.value[0], UNKNOWN], object)
        for part in slices(batches, rows_names[place]):
            best, _, spread, known = likeliest([t or "" for t in part.column(place).to_pylist()], sent.value)
            best, share = np.where(known, best, len(labels) - 1), np.where(known, 1 / spread, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[best], pa.string()), pa.array(share)], [*rows_names, *out])
    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())]))


def _predict_blocks(rows: DataFrame, model: list[Broadcast], text: str, out: tuple[str, str]) -> DataFrame:
    row, found = fresh(rows, "_row", "_found")
    # Numbered in a table, so that the rows keep their numbers.
    rows = Scratch(rows.sparkSession).cut(rows.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))

    def scored(block: int, sent: Broadcast) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels = np.array(sent.value[0], object)
            for part in slices(batches, "text"):
                best, peak, spread, known = likeliest([t or "" for t in part.column("text").to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.full(len(best), block, np.int32)), pa.array(labels[best], pa.string()),
                                                  pa.array(peak), pa.array(spread), pa.array(known)], ["row", "block", "lang", "peak", "spread", "known"])
        return texts.mapInArrow(score, "row long, block int, lang string, peak double, spread double, known boolean")
    states = reduce(DataFrame.unionAll, [scored(i, sent) for i, sent in enumerate(model)])
    # In order of blocks, so that sums don't depend on the shuffle; equal peaks go to the first block, and so to the first name.
    each = states.groupBy("row").agg(F.first("known").alias("known"), F.sort_array(F.collect_list(F.struct("block", "lang", "peak", "spread"))).alias("blocks"))
    top = each.withColumn("top", F.array_max("blocks.peak"))
    first = F.get(F.filter("blocks", lambda b: b["peak"] == F.col("top")), 0)
    spread = F.aggregate("blocks", F.lit(0.0), lambda total, b: total + b["spread"] * F.exp(b["peak"] - F.col("top")))
    merged = top.select(F.col("row").alias(row), F.struct(F.when(F.col("known"), first["lang"]).otherwise(UNKNOWN).alias("lang"),
                                                         F.when(F.col("known"), 1 / spread).otherwise(0.0).alias("score")).alias(found))
    return rows.join(merged, row).select(*[c for c in rows.columns if c != row], F.col(found)["lang"].alias(out[0]), F.col(found)["score"].alias(out[1]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    The model learns from all rows with an id, a text and a language that aren't held out. Only the
    text decides a prediction. A null text and a text without any letter give ``und`` with score 0;
    so does every text where no row has a language. Equal texts get equal results, ties go to the
    first language by name; repeated rows stay; other columns are ignored; an empty table gives an empty result."""
    out = held_out(F.col("doc_id"))
    model = fit(docs.filter(~out & F.col("doc_id").isNotNull()).select("lang", "text"))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
