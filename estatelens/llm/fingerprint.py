"""Document fingerprints: invertible Bloom lookup sketches of a document's paragraph digests."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, table
from estatelens.llm.textvec import keys64, mix64, text_bytes, word_hashes
from estatelens.operators.ranges import cut_ranges, range_bounds

# Cells of the published sketch. Differences of up to about two thirds of the cells peel.
CELLS = 48
HASHES = 3
# A paragraph is a line or sentence, cut after so many words.
PARAGRAPH_WORDS = 8
# Characters of a text that place it among others with the same id.
HEAD_CHARS = 64

_KEYS = keys64(PARAGRAPH_WORDS + 2, 31)


def paragraph_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, at)``: a 64-bit key for every paragraph of each text, and where each text's keys start.

    A paragraph ends at a line break, after a word that ends in ``.``, ``!`` or ``?``, and after
    ``PARAGRAPH_WORDS`` words. Its key is a hash of its words and of how often the text had it
    before, so a text's keys are distinct."""
    words, first, starts = word_hashes(column, lower=False)
    if not len(words):
        return words, first
    data, _ = text_bytes(column)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = np.append(starts[1:], len(data))
    # The last byte of a word: walk back over the white space before the next one starts.
    space = np.isin(data, (9, 10, 11, 12, 13, 32))
    last = np.maximum.accumulate(np.where(space, 0, np.arange(len(data))))[ends - 1]
    new = np.ones(len(words), bool)
    breaks = np.cumsum(data == 10)
    new[1:] = ((text[1:] != text[:-1]) | np.isin(data[last[:-1]], (33, 46, 63)) | (breaks[starts[1:]] != breaks[starts[:-1]]))
    begin = np.flatnonzero(new)
    place = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
    begin = np.flatnonzero(place % PARAGRAPH_WORDS == 0)
    h = mix64(np.add.reduceat(words * _KEYS[place % PARAGRAPH_WORDS], begin))
    owner = text[begin]
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), np.int64)
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    again[order] = run
    return mix64(h + again.astype(np.uint64) * _KEYS[-1]), np.searchsorted(owner, np.arange(len(first)))


def cells_of(keys: np.ndarray, cells: int, level: int) -> np.ndarray:
    """The cell of each key in each of ``HASHES`` equal parts of the sketch; other levels hash anew."""
    part = cells // HASHES
    return np.stack([(mix64(keys + _KEYS[i:i + 1] * np.uint64(level + 1)) % np.uint64(part)).astype(np.int64) + i * part
                     for i in range(HASHES)])


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)


def sketches(keys: np.ndarray, row: np.ndarray, rows: int, cells: int, level: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(count, key, check)`` per row and cell: how many keys fell there, their xor, and the xor of their checks."""
    count = np.zeros(rows * cells, np.int64)
    key, check = np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)
    for at in cells_of(keys, cells, level):
        at = at + row * cells
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, check_of(keys))
    return count, key, check


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, rows: int, cells: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, sign, whole)``: the keys recovered from subtracted sketches, all rows at once, and which rows
    were recovered wholly. A cell with a count of 1 or -1 whose check fits holds one key; taking it out frees others."""
    count, key, check = count.copy(), key.copy(), check.copy()
    got = [[], [], []]
    look = np.arange(rows * cells)
    while True:
        at = look[(np.abs(count[look]) == 1)]
        at = at[check_of(key[at]) == check[at]]
        if not len(at):
            break
        row, found, sign = at // cells, key[at], count[at]
        order = np.lexsort((found, row))
        one = order[np.r_[True, (found[order][1:] != found[order][:-1]) | (row[order][1:] != row[order][:-1])]]
        row, found, sign = row[one], found[one], sign[one]
        for col, v in zip(got, (row, found, sign)):
            col.append(v)
        touched = []
        for c in cells_of(found, cells, level):
            c = c + row * cells
            np.subtract.at(count, c, sign)
            np.bitwise_xor.at(key, c, found)
            np.bitwise_xor.at(check, c, check_of(found))
            touched.append(c)
        look = np.unique(np.concatenate(touched))
    whole = ~((count != 0) | (key != 0) | (check != 0)).reshape(rows, cells).any(1)
    empty = np.zeros(0, np.int64)
    out = [np.concatenate(c) if c else empty for c in got]
    return out[0], out[1], out[2], whole


def written(count: np.ndarray, key: np.ndarray, check: np.ndarray, rows: int, cells: int) -> list[str]:
    """Sketches as strings: number of cells, then base64 of counts, keys and checks."""
    packed = np.zeros((rows, cells), np.dtype([("count", "<u4"), ("key", "<u8"), ("check", "<u4")]))
    packed["count"], packed["key"], packed["check"] = (x.reshape(rows, cells) for x in (count, key, check))
    return [f"{cells}:{base64.b64encode(p.tobytes()).decode()}" for p in packed]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared share of paragraphs (intersection over union) of pairs of texts, given as ``(keys, at)``.

    Their sketches are subtracted and peeled, which gives the paragraphs that only one of them has. Pairs
    that don't peel are retried with sketches four times as large. Without any paragraph in either: 1."""
    rows = len(a[1]) - 1
    sizes = [np.diff(x[1]) for x in (a, b)]
    row_of = [np.repeat(np.arange(rows), s) for s in sizes]
    differ = np.full(rows, -1, np.int64)
    todo, level = np.arange(rows), 0
    while len(todo):
        index = np.full(rows, -1)
        index[todo] = np.arange(len(todo))
        total = [np.zeros(len(todo) * cells, t) for t in (np.int64, np.uint64, np.uint64)]
        for (keys, _), row, sign in ((a, row_of[0], 1), (b, row_of[1], -1)):
            use = index[row] >= 0
            part = sketches(keys[use], index[row[use]], len(todo), cells, level, sign)
            total = [total[0] + part[0], total[1] ^ part[1], total[2] ^ part[2]]
        row, _, _, whole = peel(*total, len(todo), cells, level)
        differ[todo[whole]] = np.bincount(row, minlength=len(todo))[whole]
        todo, level, cells = todo[~whole], level + 1, cells * 4
    both = (sizes[0] + sizes[1] - differ) / 2
    union = sizes[0] + sizes[1] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first characters of ``following``, or all."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def neighbours(docs: DataFrame, partitions: int) -> DataFrame:
    """``(part, last, doc_id, text)``: rows of ``docs`` in ranges of their order (descending id, null ids last, equal ids by text). The
    first row of the next range (of the first range, for the last one) is in a range once more with ``last`` set.

    Ranges have about as many rows; their bounds are sampled quantiles of the order, so null or repeated ids are
    spread over ranges by the first ``HEAD_CHARS`` characters of their texts. Rows that agree in both stay in one range."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0).alias("_all"))
    # The complement of a number falls as the number rises, without overflow.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.substring("text", 1, HEAD_CHARS).alias("head"))
    per_range = max(1, -(-rows.count() // partitions))
    # One row, with about as many bounds as ``partitions``.
    bounds = F.broadcast(Scratch(docs.sparkSession).cut(range_bounds(rows, "_all", key, per_range)))
    parted = cut_ranges(rows, "_all", key, per_range, "part", bounds=bounds).drop("_all")
    firsts = parted.select("part", key.alias("first")).groupBy("part").agg(F.min("first").alias("first"))  # a row a range
    heads = parted.join(F.broadcast(firsts), "part").filter(key == F.col("first")).groupBy("part").agg(F.min("text").alias("text"))
    line = W.orderBy("part")
    before = heads.select("part", "text", F.coalesce(F.lag("part").over(line), F.max("part").over(W.partitionBy())).alias("to"))
    carried = before.select(F.col("to").alias("part"), F.lit(True).alias("last"), F.lit(None).cast("long").alias("doc_id"), "text")
    return parted.select("part", F.lit(False).alias("last"), "doc_id", "text").unionByName(carried)


def fingerprint_edits(docs: DataFrame, partitions: int) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Documents stand in descending id (null ids last), equal ids by text; each is edited with
    the next one, the last with the first. A null text is empty. Fingerprints depend on the text
    alone; two texts without a paragraph are alike. Other columns are ignored; a single row is its own next;
    an empty table gives an empty result. A task holds the texts of one range and a very long text whole, with arrays
    of about its size; null and repeated ids are spread over ranges (see ``neighbours``)."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def work(rows: pa.Table) -> pa.Table:
        last = rows.column("last").to_numpy()
        ids = rows.column("doc_id").to_pylist()
        texts = [t or "" for t in rows.column("text").to_pylist()]
        own = sorted(np.flatnonzero(~last).tolist(), key=lambda i: (ids[i] is None, -(ids[i] or 0), texts[i]))
        out = []
        line = [texts[i] for i in own] + [texts[i] for i in np.flatnonzero(last).tolist()]  # one row is the next range's first
        size, lo = 0, 0
        for hi in range(1, len(line)):
            size += len(line[hi - 1])
            if size > 1 << 20 or hi == len(line) - 1:
                out.append(pa.RecordBatch.from_pydict(compare([ids[i] for i in own[lo:hi]], line[lo:hi + 1])))
                size, lo = 0, hi
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.Table.from_batches(out).select(names)

    def compare(ids: list, line: list[str]) -> dict:
        n = len(ids)
        texts, edits = line[:-1], [edited_text(a, b) for a, b in zip(line, line[1:])]
        keys, at = paragraph_keys(pa.array(line, pa.large_string()))
        mine, nexts = (keys[:at[n]], at[:n + 1]), (keys[at[1]:], at[1:] - at[1])
        edited = paragraph_keys(pa.array(edits, pa.large_string()))
        rows = [np.repeat(np.arange(n), np.diff(x[1])) for x in (mine, edited)]
        prints = [written(*sketches(x[0], r, n, CELLS, 0), n, CELLS) for x, r in zip((mine, edited), rows)]
        return {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits],
                "fingerprint": prints[0], "edited_fingerprint": prints[1],
                "near_edited": likeness(mine, edited), "near_next": likeness(mine, nexts)}
    return neighbours(docs, partitions).groupBy("part").applyInArrow(work, schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint_edits(docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
