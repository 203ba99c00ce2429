"""Structured Streaming entry points.

The reference is run-once batch and has no streaming operator; nothing here
adds one. What does carry over unchanged to a stream are the stateless text
jobs (sanitise, chunk, frame as messages): each input row is processed on its
own, so the same Column expressions run per micro-batch with no state store."""

from estatelens.streaming.outbox import outbox_stream

__all__ = ["outbox_stream"]
