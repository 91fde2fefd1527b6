"""Structured Streaming forms of the value-level analyses."""
