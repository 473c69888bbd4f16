"""Structured Streaming forms of the log and status operators."""
