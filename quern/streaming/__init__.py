"""Structured Streaming forms of windowed aggregation and per-key state."""
