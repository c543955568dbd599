"""Incremental harvest with Structured Streaming."""
