"""Readers, parsers and sinks for collected dumps, logs, listings and settings."""
