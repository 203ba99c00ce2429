"""Secret scans: a trigram inverted index picks the texts that a rule's regex is run on."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import fresh, table

# Kind, regex, the group whose length counts, its least length (matches under it are dropped). The
# first three are the contract's, the lengths of access and hex written into the regex: a shorter
# run of those characters holds no other match, so that is the same. The others are published formats.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
BASE = ("assign", "access", "hex")
# Parts of a regex that would multiply its alternatives beyond this count as parts that may be anything.
MAX_ALTERNATIVES = 64
# Bits of one mask, of trigrams or rules; more of them take more masks.
BITS = 62


def mandatory_strings(pattern: str) -> list[list[str]]:
    """Alternatives of strings that a match must hold: one whole list of them at least.

    Literals, alternations, small character classes and optional parts are multiplied out; what
    else may stand between them ends a string. ``[[]]`` means that nothing is mandatory."""
    gap = None  # between strings

    def walk(nodes) -> list[list]:
        ways: list[list] = [[]]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                steps = [[chr(arg)]]
            elif name == "SUBPATTERN":
                steps = walk(arg[3])
            elif name == "BRANCH":
                steps = [w for branch in arg[1] for w in walk(branch)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                steps = [[chr(a)] for _, a in arg]
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                steps = [[], *walk(arg[2])]
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                steps = [[*w, gap] for w in walk(arg[2])]
            else:
                steps = [[gap]]
            if len(ways) * len(steps) > MAX_ALTERNATIVES:
                steps = [[gap]]
            ways = [a + b for a, b in product(ways, steps)]
        return ways

    out = []
    for way in walk(re._parser.parse(pattern)):
        joined = "".join("\0" if c is gap else c for c in way)
        out.append([s for s in joined.split("\0") if len(s) >= 3])
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """The Boolean query of a regex: alternatives of trigrams that must all be in a text, lower-cased. Empty
    where an alternative has no trigram, so that every text must be scanned."""
    clauses = {frozenset(s[i:i + 3].lower() for s in way for i in range(len(s) - 2)) for way in mandatory_strings(pattern)}
    least = [c for c in clauses if not any(other < c for other in clauses)]  # others follow from these
    return [] if frozenset() in least else sorted(map(sorted, least))


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches as an array of ``(start, rank, kind, end)`` in code points.

    The text splits into what stands between matches; a match starts where all parts and
    matches before it end."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")),
                        lambda x: F.struct(F.length(x["m"]).alias("len"), (F.length(x["g"]) >= least).alias("ok")))
    # Few matches a text: the running sum is taken over the matches alone.
    starts = F.transform(found, lambda x, i: F.struct(
        (F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v)
         + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, v: a + v["len"])).alias("start"),
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["len"].alias("end"), x["ok"].alias("ok")))
    kept = F.filter(starts, lambda x: x["ok"])
    return F.transform(kept, lambda x: F.struct(x["start"], x["rank"], x["kind"], (x["start"] + x["end"]).alias("end")))


def candidates(texts: DataFrame, rules: list[tuple]) -> DataFrame:
    """``_key`` and the masks ``_rules0``, ``_rules1``, ... of the distinct texts of ``texts`` (``_key``, ``_text``) that a rule's
    Boolean query admits; bit b of mask m stands for rule ``BITS`` * m + b.

    Postings are (trigram, text) for the trigrams of the rules alone, so the index is bounded by rules
    times texts. A text passes an alternative when it is in the postings of all its trigrams."""
    spark = texts.sparkSession
    clauses = [(g, i, r, c, len(clause)) for r, (_, pattern, _, _) in enumerate(rules)
               for c, clause in enumerate(trigram_query(pattern)) for i, g in enumerate(clause)]
    masks = [f"_rules{m}" for m in range(-(-len(rules) // BITS))]
    if not clauses:
        return spark.createDataFrame([], ", ".join(["_key string", *[f"{m} long" for m in masks]]))
    vocabulary = F.array(*[F.lit(g) for g in sorted({c[0] for c in clauses})])
    # The one-element array binds the lower-cased text once.
    held = F.transform(F.array(F.lower("_text")), lambda low: F.filter(vocabulary, lambda g: F.contains(low, g)))[0]
    postings = texts.select("_key", F.explode(held).alias("gram"))
    query = spark.createDataFrame(clauses, "gram string, at int, rule int, clause int, need int")  # as long as the rule list

    def bits(number: str, of: int) -> Column:
        """The bit of ``number`` in mask ``of``, null where it is in another."""
        return F.when(F.floor(F.col(number) / BITS) == of, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number) % BITS))

    # One posting of a trigram per text, also where texts repeat: bits of the alternative's trigrams, not counts. An
    # alternative of more trigrams than a mask has bits takes several masks.
    words = range(-(-max(c[4] for c in clauses) // BITS))
    met = postings.join(F.broadcast(query), "gram").groupBy("_key", "rule", "clause", "need").agg(*[F.bit_or(bits("at", m)).alias(f"m{m}") for m in words])
    found = sum((F.coalesce(F.bit_count(f"m{m}"), F.lit(0)) for m in words), F.lit(0))
    return met.filter(found == F.col("need")).groupBy("_key").agg(*[F.coalesce(F.bit_or(bits("rule", m)), F.lit(0)).alias(name) for m, name in enumerate(masks)])


def secret_spans(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of ``(start, rank, kind, end)`` sorted by start, then rule; code points, end exclusive.

    Per rule, matches are leftmost and don't overlap; those whose counted group is too short
    are dropped. Rules whose regex has mandatory trigrams run on the texts that the index admits,
    the others on every text. Spans of different rules may overlap.

    Null and empty texts have no spans. Equal texts are indexed once and get equal spans; repeated
    rows stay; an input column named ``secrets`` is replaced, others are kept. An empty table
    gives an empty result, an empty rule list gives empty arrays. Rules may be many and their literals long."""
    key, = fresh(docs, "_key")
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "secrets"])
    body = F.coalesce(F.col(text), F.lit(""))
    admitted = candidates(docs.select(F.md5(body).alias("_key"), body.alias("_text")), rules)
    masks = fresh(docs, *[c for c in admitted.columns if c != "_key"])
    admitted = admitted.toDF(key, *masks)
    at = docs.withColumn(key, F.md5(body)).join(admitted, key, "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = [empty]
    for r, (kind, pattern, group, least) in enumerate(rules):
        due = F.col(text).rlike(pattern)
        if trigram_query(pattern):
            due = (F.coalesce(masks[r // BITS], F.lit(0)).bitwiseAND(1 << r % BITS) != 0) & due
        parts.append(F.when(due, spans_of(F.col(text), pattern, group, least, kind, r)).otherwise(empty))
    return at.withColumn("secrets", F.array_sort(F.concat(*parts))).drop(key, *masks)


def redact(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping secrets become one, named by the first."""
    columns = docs.columns
    found = secret_spans(docs, text, rules)

    def step(acc: Column, s: Column) -> Column:
        fresh_part = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], fresh_part).otherwise(acc["out"]).alias("out"))
    clean = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text))).select(*columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """The spans from each regex's pieces between matches, with every rule run on every text."""
    parts = []
    for r, (kind, pattern, group, least) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {r} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
            'start': coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0),
            'len': length(ms[i]), 'ok': length(gs[i]) >= {least}}})) AS m
          FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS between, regexp_extract_all(text, {p}, 0) AS ms,
                       regexp_extract_all(text, {p}, {group}) AS gs FROM documents WHERE regexp_matches(text, {p}))""")
    base = f"kind IN ({', '.join(repr(k) for k in BASE)})"
    written = "kind || ':' || first::BIGINT || ':' || past::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH spans AS (
  SELECT doc_id, rank, kind, m.start AS first, m.start + m.len AS past FROM ({" UNION ALL ".join(parts)}) WHERE m.ok)
SELECT doc_id, {counts}, sha256(coalesce(string_agg({written}, ',' ORDER BY first, rank) FILTER ({base}), '')) AS base_sha256,
  coalesce(string_agg({written}, ',' ORDER BY first, rank), '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


OP7_SQL = _sql()
