"""Structured Streaming over append-only events."""
