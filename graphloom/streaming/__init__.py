"""Structured Streaming front of the incremental build."""
