"""URL filters: host-suffix and path-prefix expressions joined to a rule list on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import fresh, table

# Hex digits of the digest on which expressions and rules are joined; the full digest is compared afterwards.
PREFIX_DIGITS = 8

# Up to so many rules are sent to all executors; more are joined by a shuffle.
BROADCAST_RULES = 100_000

# The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (ASCII letters lower-cased) and path of ``url``; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; one output row per input row.

    ``rules`` has ``host`` (a domain; it also fits every subdomain), ``path`` (starts and
    ends with ``/``) and ``verdict``. The rule that fits with the longest host, then the
    longest path, decides; equal rules with different verdicts: ``block`` wins. Without a
    rule that fits, ``rule`` is null and ``verdict`` is ``default``.

    Each URL expands into its host suffixes (cut at dots) times its path prefixes (cut
    at slashes), no deeper than the deepest rule, and joins the rules on the first
    digits of a SHA-256 digest; rows stay only where the whole digest agrees.

    Null or malformed URLs: empty host and path, no rule. Input columns named like an
    output column are replaced; other columns and repeated rows are kept. Empty tables
    give empty results; rules that are null or whose path doesn't start and end with a
    slash raise an error when the query runs."""
    row, suffixes, prefixes, expr, short, digest, hit, r_digest = fresh(
        pages, "_row", "_suffixes", "_prefixes", "_expr", "_short", "_digest", "_hit", "_rule_digest")
    host, path = host_and_path(F.col(url).cast("string"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # Three integers: no expression deeper than every rule can match.
    deep = rules.agg(F.count(F.lit(1)).alias("rules"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                     F.max(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("cuts")).first()
    labels, cuts = deep["labels"] or 0, deep["cuts"] or 0

    checked = rules.select(
        F.when(F.col("path").rlike("^/(.*/)?$") & F.col("host").isNotNull() & F.col("verdict").isNotNull(), F.col("host"))
        .otherwise(F.raise_error(F.lit("a rule needs a host, a verdict and a path that starts and ends with /"))).alias("host"),
        "path", "verdict")
    listed = (checked.groupBy(_lower(F.col("host")).alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("v"))
              .withColumn(r_digest, _digest(F.col("h"), F.col("p")))
              .select(F.substring(r_digest, 1, PREFIX_DIGITS).alias(short), r_digest,
                      F.struct(F.length("h").alias("host_length"), F.length("p").alias("path_length"),
                               F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")).alias(hit)))

    parts = F.split("host", r"\.")
    pieces = F.split("path", "/")
    n_suffix = F.least(F.size(parts), F.lit(labels))
    n_prefix = F.least(F.size(pieces) - 1, F.lit(cuts))
    at = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn(row, F.monotonically_increasing_id())
    expanded = (
        at.withColumn(suffixes, F.when(n_suffix > 0, F.transform(F.sequence(F.lit(1), n_suffix),
                                                                lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
                      .otherwise(F.array().cast("array<string>")))
        .withColumn(prefixes, F.when((n_prefix > 0) & F.col("path").startswith("/"), F.transform(
            F.sequence(F.lit(1), n_prefix), lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))))
            .otherwise(F.array().cast("array<string>")))
        .withColumn(expr, F.explode_outer(F.flatten(F.transform(
            suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))))
        .withColumn(short, F.substring(expr, 1, PREFIX_DIGITS)).drop(suffixes, prefixes))
    few = deep["rules"] <= BROADCAST_RULES
    found = expanded.join(F.broadcast(listed) if few else listed, short, "left").withColumn(
        hit, F.when(F.col(expr) == F.col(r_digest), F.col(hit)))
    # The rows of a page meet in the same task as they were made, so the partial aggregate leaves one of each.
    best = found.groupBy(row).agg(F.max(hit).alias(hit), *[F.first(c).alias(c) for c in (*kept, "host", "path")])
    return best.select(*kept, "host", "path", F.col(f"{hit}.rule").alias("rule"),
                       F.coalesce(F.col(f"{hit}.verdict"), F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


OP4_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1]))))}
         END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE rule {" ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)} ELSE 'allow' END AS verdict
FROM judged"""
