"""Incremental ingest of staged feed files with Structured Streaming."""
