"""Chat formatting: turns of a conversation as one training string with a loss mask, in Spark expressions only.

Template, per run of adjacent turns of the same role::

    <s>role[INST]text[SEP]text...[/INST]</s>

``[SEP]`` stands between the texts of merged turns, so formatting loses nothing.
Control strings inside roles and texts are escaped by one backslash after their
first character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which
``unescape`` takes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import table

# The template's control strings.
BLOCK_OPEN, BLOCK_CLOSE, TEXT_OPEN, TEXT_CLOSE, TEXT_NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[SEP]"
ESCAPE_RULES = ((r"<(\\*)(/?s>)", "<"), (r"\[(\\*)(/?INST\]|SEP\])", "["))
UNESCAPE_RULES = ((r"<\\(\\*)(/?s>)", "<"), (r"\[\\(\\*)(/?INST\]|SEP\])", "["))


def escape(c: Column) -> Column:
    for pattern, first in ESCAPE_RULES:
        c = F.regexp_replace(c, pattern, first + r"\\$1$2")
    return c


def unescape(c: Column) -> Column:
    for pattern, first in UNESCAPE_RULES:
        c = F.regexp_replace(c, pattern, first + "$1$2")
    return c


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments``, an array of
    ``(text, loss)`` whose texts concatenate to ``formatted``; ``loss`` marks what a model trains on.

    Turns are ordered by ``turn`` (nulls first), ties by role, then text. Adjacent turns of
    the same role merge into one block. A null role or text counts as empty; a null
    conversation id is a conversation of its own; repeated rows are repeated turns;
    other columns are ignored. An empty table gives no rows.

    Escaping runs on each turn before the shuffle; only building the one string of a
    conversation needs its turns in one place."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
                 escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                 F.coalesce(F.col(role).isin(*trained), F.lit(False)).alias("loss")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def pieces(t: Column, i: Column) -> Column:
        """A turn's part of the string: what opens it, its text, and what closes its block."""
        same_before = (i > 0) & (F.get("ts", i - 1)["role"] == t["role"])
        same_after = F.coalesce(F.get("ts", i + 1)["role"] == t["role"], F.lit(False))
        opening = F.when(same_before, TEXT_NEXT).otherwise(F.concat(F.lit(BLOCK_OPEN), t["role"], F.lit(TEXT_OPEN)))
        closing = F.when(same_after, "").otherwise(TEXT_CLOSE + BLOCK_CLOSE)
        segment = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(segment(opening, F.lit(False)), segment(t["text"], t["loss"]), segment(closing, F.lit(False)))

    return (sorted_turns.withColumn("segments", F.flatten(F.transform("ts", pieces)))
            .select("conv_id", F.concat_ws("", F.col("segments.text")).alias("formatted"), "segments"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted string, unescaped and in order."""
    blocks = F.split(formatted, "</s>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def of_block(b: Column) -> Column:
        role = F.substring_index(b, TEXT_OPEN, 1)
        role = F.substring(role, F.lit(len(BLOCK_OPEN) + 1), F.length(role))
        body = F.substring_index(F.substring_index(b, TEXT_OPEN, -1), TEXT_CLOSE, 1)
        return F.transform(F.split(body, r"\[SEP\]"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(blocks, of_block))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, read back from the formatted output."""
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(turns).withColumn("back", read_turns(F.col("formatted")))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(c: str) -> str:
    for pattern, first in ESCAPE_RULES:
        c = f"regexp_replace({c}, '{pattern}', '{first}\\\\\\1\\2', 'g')"
    return c


OP8_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, {_sql_escape('role')} AS erole, {_sql_escape('text')} AS etext,
         coalesce(lag(role) OVER w = role, false) AS joined FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN joined THEN 5 ELSE 20 + length(erole) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
