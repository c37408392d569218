"""Structured Streaming: incremental ingest and running counts."""
