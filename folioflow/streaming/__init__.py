"""Structured Streaming twins of the polling steps."""
