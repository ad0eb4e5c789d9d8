"""Structured Streaming forms of the windows."""
