"""Structured Streaming: windows, deduplication, group state, and logs of records."""
