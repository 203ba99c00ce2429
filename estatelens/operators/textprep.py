"""Text preparation over text tables (X16-X28): sanitise, chunk, frame as messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.chunk import pack_chunks, pack_chunks_arrow
from estatelens.functions.html import sanitize


def sanitize_table(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    """X20 on one column of a table. Text jobs are CPU-bound per row: a caller whose
    table comes in a few large files may repartition it first."""
    return df.withColumn(out, sanitize(col))


def explode_chunks(df: DataFrame, key: str, col: str, max_length: int = 3000,
                   drop_empty: bool = False, engine: str = "native") -> DataFrame:
    """X24 + posexplode: ``(key, part, n_parts, chunk, n_chars)``, one row per
    chunk, ``part`` from 0. Texts without a chunk give no rows (Q16).
    ``engine="native"`` is the JVM array fold; ``"arrow"`` the pandas UDF."""
    if engine == "native":
        packed_col = pack_chunks(col, max_length, drop_empty)
    elif engine == "arrow":
        packed_col = pack_chunks_arrow(col, max_length)
        if drop_empty:
            packed_col = F.filter(packed_col, lambda c: c != F.lit(""))
    else:
        raise ValueError(f"unknown engine {engine!r}")
    packed = df.select(F.col(key), packed_col.alias("_c"))
    # ``posexplode_outer`` + a filter on its output: a plain ``posexplode`` makes
    # the optimizer infer ``size(_c) > 0`` and push it below the projection,
    # which would evaluate the packing twice.
    return (packed.select(key, F.size("_c").alias("n_parts"), F.posexplode_outer("_c").alias("part", "chunk"))
            .filter(F.col("chunk").isNotNull())
            .select(key, "part", "n_parts", "chunk", F.length("chunk").alias("n_chars")))


# Own display defaults for message framing.
MESSAGE_TEXT = {
    "banner": "Price moves in the property market",
    "footer": "\n\nFollow the channel for new reports.",
    "tags": "\n\n#realestate #prices #listings",
    "retry_suffix": " [cut; see the full report]",
}


def message_header(as_of: datetime, banner: str | None = None) -> str:
    """Header put before the first chunk: banner with the run time, blank line."""
    b = MESSAGE_TEXT["banner"] if banner is None else banner
    return f"{b} - {as_of:%d.%m.%Y %H:%M}\n\n"


def message_footer(footer: str | None = None, tags: str | None = None) -> str:
    return (MESSAGE_TEXT["footer"] if footer is None else footer) + (MESSAGE_TEXT["tags"] if tags is None else tags)


def messages(chunks: DataFrame, key: str, header: str, footer: str, max_chars: int = 4000,
             retry_over: int = 1000, retry_keep: int = 950, retry_suffix: str | None = None) -> DataFrame:
    """The outbox. Header before part 0, footer after the last part,
    messages over ``max_chars`` cut to ``max_chars - 3`` + ``...``; a shorter
    retry text for messages over ``retry_over``; length and preview columns."""
    suffix = MESSAGE_TEXT["retry_suffix"] if retry_suffix is None else retry_suffix
    t = F.col("chunk")
    t = F.when(F.col("part") == 0, F.concat(F.lit(header), t)).otherwise(t)
    t = F.when(F.col("part") == F.col("n_parts") - 1, F.concat(t, F.lit(footer))).otherwise(t)
    framed = chunks.select(F.col(key).alias("report_id"), "part", "n_parts", t.alias("_t"))
    over = F.length("_t") > max_chars
    text = F.when(over, F.concat(F.substring("_t", 1, max_chars - 3), F.lit("..."))).otherwise(F.col("_t"))
    out = framed.select("report_id", "part", "n_parts", text.alias("text"), over.alias("was_trimmed"))
    return out.select(
        "report_id", "part", "n_parts", "text",
        F.length("text").alias("n_chars"),
        F.substring("text", 1, 100).alias("preview"),
        "was_trimmed",
        F.when(F.length("text") > retry_over,
               F.concat(F.substring("text", 1, retry_keep), F.lit(suffix))).alias("retry_text"),
    )
