"""Structured Streaming forms of the sequential rules; each has a batch twin that gives the same rows."""
