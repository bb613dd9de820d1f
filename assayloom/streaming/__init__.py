"""Structured Streaming forms of the ingest and result feeds."""
