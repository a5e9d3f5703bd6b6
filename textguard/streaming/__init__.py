"""Structured Streaming forms of scoring and of the attempt lockout."""
