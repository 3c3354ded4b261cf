"""Structured Streaming twins of the batch stages."""
