"""Structured Streaming forms of the continuous monitors."""
