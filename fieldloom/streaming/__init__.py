"""Structured Streaming forms of the time-step operators."""
