"""Structured Streaming jobs (file source, keyed state, foreachBatch sinks)."""
