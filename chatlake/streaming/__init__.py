"""Structured Streaming twins of ingest and roll-ups (STR1-3)."""
