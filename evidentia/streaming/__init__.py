"""Structured Streaming forms of batch answers."""
