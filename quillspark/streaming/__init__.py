"""Structured Streaming forms of the call log and of feedback."""
