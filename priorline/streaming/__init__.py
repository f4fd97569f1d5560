"""Structured Streaming forms of the incremental load and the daily totals."""
