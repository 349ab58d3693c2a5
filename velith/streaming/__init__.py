"""Incremental ingestion and embedding with Structured Streaming."""
