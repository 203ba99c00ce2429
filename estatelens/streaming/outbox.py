"""Texts landing as files -> sanitised, chunked, framed messages in an outbox.

``foreachBatch`` writes each micro-batch to ``<sink>/batch_id=<id>``,
overwriting that folder, so a batch replayed after a failure (the checkpoint
records which batches committed) replaces its own output instead of
duplicating it. Use a checkpoint location on shared storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelens.functions.chunk import pack_chunks
from estatelens.functions.html import sanitize
from estatelens.operators.textprep import message_footer, message_header, messages


def frame_texts(df: DataFrame, key: str, text: str, header: str, footer: str, max_length: int = 3000) -> DataFrame:
    """Sanitise -> chunk -> frame, row-local (no shuffle, no state)."""
    packed = df.select(F.col(key), pack_chunks(sanitize(text), max_length).alias("_c"))
    chunks = (packed.select(key, F.size("_c").alias("n_parts"), F.posexplode_outer("_c").alias("part", "chunk"))
              .filter(F.col("chunk").isNotNull()))
    return messages(chunks, key, header, footer)


def outbox_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str,
                  as_of: datetime, key: str = "doc_id", text: str = "text", fmt: str = "parquet", available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """Start the stream and return the ``StreamingQuery``. ``as_of`` is the time in every header."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.load(source_dir)
    header = message_header(as_of)
    footer = message_footer()
    out = frame_texts(src, key, text, header, footer)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = out.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
