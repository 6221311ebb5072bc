"""Structured Streaming counterparts of the count summaries."""
