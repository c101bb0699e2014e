"""Structured Streaming forms of frame ingest and stacking."""
