"""Structured Streaming twins of the batch monitoring operators."""
