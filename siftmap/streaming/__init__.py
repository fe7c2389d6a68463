"""Structured Streaming jobs over reviewer decisions."""
