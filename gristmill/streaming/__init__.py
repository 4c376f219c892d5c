"""Structured Streaming forms of the input checks."""
