"""A training-data pipeline over ``documents``: language, near-duplicates, secrets, mix, sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet and
reads it again as the next one's ``docs``. All stages but the last return the columns of
``docs``. Rows with null columns and repeated rows are rows like others; empty tables pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, fresh, table
from estatelens.llm.language_id import fit, held_out, predict
from estatelens.llm.mixing import mix, word_count
from estatelens.llm.ngram_join import ngram_join
from estatelens.llm.packing import pack
from estatelens.llm.secret_scan import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; only those without a letter go, however unsure the language is."""
    model = fit(docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("lang", "text"))
    if not model:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "_lang_pred", "_score")
    # A posterior is 0 for texts without a letter only; "und" may also be a label that rows have.
    return predict(docs, model, out=(lang, score)).filter(F.col(score) > 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id. Empty texts are no duplicates."""
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    row, columns = "doc_id", docs.columns
    if len(set(ids)) > 1:  # ids are null or repeated: number the rows, in a table so that they keep their numbers
        row, = fresh(docs, "_row")
        docs = Scratch(spark).cut(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = ngram_join(docs, doc_id=row).filter("doc_id = component_id").select(F.col("doc_id").alias(row))
    return docs.join(kept, row, "left_semi").select(*columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by their kind."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as whole documents: each as often as the words that the mix takes of it come nearest to."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    # The quotas need no texts: they come from a narrow table.
    measured = Scratch(spark).cut(rows.drop("doc"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mix(rows, measured=measured).filter((F.col("size") > 0) & (times > 0))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, with their ids, in sequences of 2048."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

# The tokenizer and the language model aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
