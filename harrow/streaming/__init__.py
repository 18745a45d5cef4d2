"""Structured Streaming form of the page scoring (incremental captures)."""
