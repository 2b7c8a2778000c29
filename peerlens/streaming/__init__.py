"""Structured Streaming jobs over the usage-event log."""
