"""Structured Streaming: incremental ingest and running means."""
