"""Structured Streaming assembly of the operators."""
