"""Structured Streaming wrappers of the realtime operators."""
