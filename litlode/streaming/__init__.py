"""Incremental harvests with Structured Streaming."""
