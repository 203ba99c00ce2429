"""Byte-level BPE encoding and decoding: an automaton finds longest tokens, backtracking joins compatible ones."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from estatelens.llm.common import table
from estatelens.llm.textvec import slices

RANKS = "byte_bpe_50k.tiktoken"
# Encodings of pieces and verdicts on pairs that a task remembers, and the longest piece it remembers; they speed
# things up and never change a result.
REMEMBERED = 1 << 19
REMEMBERED_CHARS = 64
# Pieces, or ids, of one long text that are held as Python objects at once.
AT_ONCE = 1 << 16


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a token in base64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Plain BPE: merges the two neighbours whose joint token has the lowest rank, the leftmost of equals, until
    ``until`` parts or no such neighbours are left. Quadratic: for tokens, not for texts."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > until:
        joint = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((r for r in joint if r is not None), default=None)
        if best is None:
            break
        at = joint.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary(NamedTuple):
    """What an encoder needs of a vocabulary; its size is the vocabulary's."""

    ranks: dict[bytes, int]
    halves: dict[int, tuple[int, int]]  # what a token was merged from, of tokens of two bytes or more
    shorter: dict[int, int]  # the longest proper prefix of a token that is a token; -1 if none is
    automaton: ahocorasick.Automaton  # over the tokens, byte for byte as Latin-1; gives (length less one, rank)


def prepare(ranks: dict[bytes, int]) -> Vocabulary:
    """Tokens that merging their own bytes doesn't give are left out of the automaton: merging never gives them in
    a longer piece either, and a piece that is such a token gets its id by itself."""
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"the vocabulary lacks the bytes {lacking}")
    own, halves, automaton = {}, {}, ahocorasick.Automaton()
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, until=2)
            if len(parts) > 2:
                continue
            halves[rank] = ranks[parts[0]], ranks[parts[1]]
            if max(halves[rank]) >= rank:
                raise ValueError(f"token {token!r} ranks before a part that it is merged from")
        own[token] = rank
        automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
    automaton.make_automaton()
    shorter = {rank: next((own[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in own), -1) for token, rank in own.items()}
    return Vocabulary(ranks, halves, shorter, automaton)


class Encoder(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers: ``encoder[piece]``.

    The automaton gives the longest token at each place of a piece. From left to right a token is
    appended if it and the one before are compatible, that is if merging the bytes of both gives just
    these two; else the next shorter prefix that is a token is tried. Where none fits, the place is
    dead: the token before is taken back and shortened. Merging gives one sequence for a prefix, so a
    place is reached by one sequence only, and a dead place stays dead: the work is linear in the piece."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.ranks, self.halves, self.shorter, self.automaton = vocabulary
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.size = {r: len(t) for t, r in self.ranks.items()}
        self.verdicts: dict[int, dict[int, bool]] = {}  # by the left token, then by the right one
        self.judged = 0

    def __missing__(self, piece: str) -> bytes:
        octets = piece.encode("utf-8")
        rank = self.ranks.get(octets)
        ids = [rank] if rank is not None else self.tokens(octets.decode("latin-1"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two; remembered."""
        if self.judged >= REMEMBERED:
            self.verdicts.clear()
            self.judged = 0
        self.judged += 1
        verdict = self.verdicts.setdefault(left, {})[right] = not self.crossed(left, right)
        return verdict

    def crossed(self, left: int, right: int) -> bool:
        """Whether a merge across the border of two tokens comes before one of them is whole.

        Merges come in the order of their ranks, so what touches the border is known backwards in time: the
        whole tokens, then the halves of the one merged last, and so on. A joint token of the two
        that touch is merged if it ranks before the merge that ends this pair; with equal ranks the one
        further left comes first, which is the joint token's unless the pair ends on the left."""
        halves, ends, ends_left = self.halves, None, False
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and (ends is None or joint < ends or (joint == ends and not ends_left)):
                return True
            if left not in halves and right not in halves:
                return False
            # Of two equal tokens the right one is merged last.
            ends_left = right not in halves or (left in halves and left > right)
            if ends_left:
                ends, left = left, halves[left][1]
            else:
                ends, right = right, halves[right][0]

    def tokens(self, octets: str) -> list[int]:
        """The ids of a piece, given as Latin-1."""
        size, shorter, end = self.size, self.shorter, len(octets)
        longest = [-1] * end
        for last, (less, rank) in self.automaton.iter(octets):
            longest[last - less] = rank  # ends come in order, so the longest stays
        dead = bytearray(end + 1)
        out: list[int] = []
        at, token, before = 0, longest[0] if end else -1, -1
        while at < end:
            known = self.verdicts.get(before, {})
            while token >= 0:
                if not dead[at + size[token]]:
                    if before < 0:
                        break
                    fits = known.get(token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = at + size[token], token
                token = longest[at] if at < end else -1
            else:
                dead[at] = 1
                token = out.pop()
                at, before = at - size[token], out[-1] if out else -1
        return out


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``docs`` without ``text``, then ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned
    32-bit ids): each match of ``pattern`` in the text by the ranks of the ``.tiktoken`` file at ``path``, without special tokens.

    A null or empty text has no ids. A very long text is held whole, with its ids, but its pieces are
    taken a block at a time, and one very long piece costs about 40 bytes a byte more. Every row is encoded on its own, so
    repeated rows, ties and null ids need no rule, and an empty table gives an empty result. Input columns named
    ``n_tokens`` or ``ids`` are replaced. Nothing is shuffled; a lost task is encoded again."""
    path = path or public_tokenizers.path(RANKS)
    pattern = pattern or public_tokenizers.PATTERN
    spark = docs.sparkSession
    with open(path, "rb") as f:
        # One vocabulary's tables: they don't grow with the rows.
        vocabulary = spark.sparkContext.broadcast({"tables": tuple(prepare(read_ranks(f.read())))})
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids", text.lower())]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Python worker keeps its copy of a broadcast value, so its next tasks find the encoder with what it remembers.
        mine = vocabulary.value
        if "encoder" not in mine:
            mine["encoder"] = Encoder(Vocabulary(*mine["tables"]))
        encoder = mine["encoder"]
        matches = regex.compile(pattern)
        for part in slices(batches, "text"):
            ids = []
            for t in part.column(part.num_columns - 1).to_pylist():
                if len(t or "") <= AT_ONCE and not matches.groups:
                    ids.append(b"".join([encoder[piece] for piece in matches.findall(t or "")]))
                    continue
                found, of_text = matches.finditer(t or ""), []
                while pieces := [m.group() for m in islice(found, AT_ONCE)]:
                    of_text.append(b"".join([encoder[piece] for piece in pieces]))
                ids.append(b"".join(of_text))
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts, pa.array(ids, pa.binary())], [*kept, "n_tokens", "ids"])

    rows = docs.select(*kept, F.col(text).alias("text"))
    schema = StructType([*rows.drop("text").schema.fields]).add("n_tokens", LongType()).add("ids", BinaryType())
    return rows.mapInArrow(encoded, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with ``out`` (binary) in place of ``ids``: the bytes of all ids joined, the inverse of ``encode``.

    Null ids decode to no bytes. An id without a token fails the job. A column named like ``out`` is replaced."""
    path = path or public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        vocabulary = rows.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in rows.columns if c.lower() not in (ids.lower(), out.lower())]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: t for t, rank in read_ranks(vocabulary.value).items()}
        for part in slices(batches, "ids"):
            texts = []
            for raw in part.column(part.num_columns - 1).to_pylist():
                numbers = np.frombuffer(raw or b"", "<u4")
                texts.append(b"".join(b"".join([token[i] for i in numbers[a:a + AT_ONCE].tolist()])
                                      for a in range(0, len(numbers), AT_ONCE)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary())], [*kept, out])

    narrow = rows.select(*kept, F.col(ids).alias("ids"))
    schema = StructType([*narrow.drop("ids").schema.fields]).add(out, BinaryType())
    return narrow.mapInArrow(decoded, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    return decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
